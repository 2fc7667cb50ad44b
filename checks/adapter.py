"""The engine's tables derived from the test tables.

The SQL text is the same for Spark and DuckDB; only the epoch expression
differs. Every row and every whole text of events, documents, conversations
and embeddings is used.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from chatterlens.functions.fixed_values import TAXONOMY
from chatterlens.sources.corpus import Corpus

EPOCH_SPARK = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', e.ts)"
EPOCH_DUCKDB = "CAST(floor(epoch(e.ts)) AS BIGINT)"

VIEWS = {
    "messages": """
SELECT 'm_' || CAST(e.event_id AS STRING) AS id,
       CASE WHEN e.user_id % 2 = 0 THEN 'discord' ELSE 'reddit' END AS platform,
       CASE WHEN d.doc_id IS NOT NULL THEN d.text
            WHEN e.event_id % 6 = 0 THEN 'costs $' || CAST(e.event_id % 90 AS STRING) || ' for ' || e.event_type
            WHEN e.event_id % 6 = 1 THEN e.event_type || ' at ' || CAST(e.event_id % 50 AS STRING) || '/mo'
            WHEN e.event_id % 6 = 2 THEN 'Need to export the ' || e.event_type || ' table from Supabase'
            WHEN e.event_id % 6 = 3 THEN 'How do I connect Stripe' || chr(10) || 'to the ' || e.event_type || ' API?'
            WHEN e.event_id % 6 = 4 THEN 'The ' || e.event_type || ' dashboard is slow' || CASE WHEN e.value > 50 THEN ' and the login email webhook has a bug' ELSE '' END
            ELSE 'ok ' || e.event_type END AS content,
       'u_' || CAST(e.user_id AS STRING) ||
       CASE WHEN e.event_id % 16 < 12 THEN '' WHEN e.event_id % 16 < 14 THEN '_alt'
            WHEN e.event_id % 16 = 14 THEN '_two' ELSE '_' || CAST(e.event_id % 3 AS STRING) END AS author_id,
       {epoch} AS timestamp,
       {epoch} + 60 AS scraped_at,
       coalesce(d.source, 'events') AS source,
       CASE WHEN e.event_id % 3 <> 0
            THEN 'm_' || CAST(CAST(floor(e.event_id / 2) AS BIGINT) AS STRING) END AS parent_id,
       e.props AS metadata
FROM {events} e LEFT JOIN {documents} d ON d.doc_id = e.event_id
UNION ALL
SELECT 'c_' || CAST(c.conv_id AS STRING) || '_' || CAST(c.turn AS STRING) AS id,
       CASE WHEN c.conv_id % 2 = 0 THEN 'discord' ELSE 'reddit' END AS platform,
       c.text AS content,
       CASE WHEN c.role = 'user' THEN 'u_c' || CAST(c.conv_id AS STRING) ELSE 'u_' || c.role || '_bot' END ||
       CASE WHEN c.conv_id % 2 = 0 THEN '_d' ELSE '_r' END AS author_id,
       1704067200 + c.conv_id * 600 + c.turn * 30 AS timestamp,
       1704067200 + c.conv_id * 600 + c.turn * 30 + 60 AS scraped_at,
       'conversations' AS source,
       CASE WHEN c.turn > 0
            THEN 'c_' || CAST(c.conv_id AS STRING) || '_' || CAST(c.turn - 1 AS STRING) END AS parent_id,
       '{"type": ' || CASE WHEN c.role = 'system' THEN '7' ELSE '0' END || ', "author": "' || c.role || '"}' AS metadata
FROM {conversations} c""",
    # Run 1 labels every event; run 2 labels all purchases again, so some messages hold two
    # categories. Conversation turns stay unclassified.
    "message_taxonomy": """
SELECT CAST(1 AS BIGINT) AS taxonomy_run_id, 'm_' || CAST(e.event_id AS STRING) AS message_id, CASE
  WHEN e.event_type = 'signup'   THEN CASE WHEN e.event_id % 2 = 0 THEN 'integration_requests' ELSE 'authentication_needs' END
  WHEN e.event_type = 'purchase' THEN CASE WHEN e.event_id % 2 = 0 THEN 'pricing_complaints' ELSE 'customization_requests' END
  WHEN e.event_type = 'view'     THEN CASE WHEN e.event_id % 2 = 0 THEN 'questions' ELSE 'spam_noise' END
  WHEN e.event_type = 'click'    THEN CASE WHEN e.event_id % 2 = 0 THEN 'feature_requests' ELSE 'usability_problems' END
  ELSE CASE WHEN e.event_id % 2 = 0 THEN 'bug_reports' ELSE 'performance_issues' END END AS category,
  CAST(1706745600 AS BIGINT) AS created_at
FROM {events} e
UNION ALL
SELECT CAST(2 AS BIGINT), 'm_' || CAST(e.event_id AS STRING), 'pricing_complaints', CAST(1706832000 AS BIGINT)
FROM {events} e WHERE e.event_type = 'purchase'""",
    "taxonomy_runs": """
SELECT taxonomy_run_id AS id, 'rules' AS model, 'v1' AS taxonomy_version, count(*) AS n_messages,
       CAST(100 AS BIGINT) AS batch_size, CAST(ceil(count(*) / 100.0) AS BIGINT) AS total_batches,
       CAST(count(*) AS DOUBLE) / 64 AS processing_time_seconds, max(created_at) AS created_at
FROM {message_taxonomy} GROUP BY taxonomy_run_id""",
    "users": """
SELECT author_id AS id, platform, replace(replace(author_id, 'u_', 'user_'), '_alt', '') AS username,
       CAST(NULL AS STRING) AS display_name, count(*) AS message_count,
       min(timestamp) AS first_seen, max(timestamp) AS last_seen, CAST(NULL AS STRING) AS metadata
FROM {messages} GROUP BY author_id, platform""",
    "extracted_entities": """
SELECT e.event_id AS id, 'm_' || CAST(e.event_id AS STRING) AS message_id,
       CASE WHEN e.event_type = 'error' THEN 'pain_point' WHEN e.event_type = 'signup' THEN 'integration'
            WHEN e.event_type = 'click' THEN 'feature' ELSE 'workaround' END AS entity_type,
       'e_' || CAST(e.event_id % 23 AS STRING) AS entity_name,
       CASE WHEN e.event_id % 23 > 18 THEN 'e_merged' END AS canonical_name,
       'cat_' || CAST(e.event_id % 3 AS STRING) AS category,
       e.event_type || ' ' || CAST(e.event_id AS STRING) AS context,
       CASE WHEN e.event_id % 13 <> 0 THEN CAST(e.event_id % 100 AS DOUBLE) / 100 END AS confidence,
       CAST(NULL AS STRING) AS extraction_metadata
FROM {events} e""",
    "embeddings_reference": """
SELECT v.vec_id AS id, 'm_' || CAST(v.vec_id AS STRING) AS message_id, 'x_' || CAST(v.vec_id AS STRING) AS chromadb_id,
       'hashing' AS embedding_model, CAST(1706745600 AS BIGINT) AS created_at
FROM {embeddings} v""",
    "vectors": """
SELECT 'm_' || CAST(v.vec_id AS STRING) AS message_id, v.embedding AS embedding, v.label AS label,
       m.platform AS platform, m.source AS source, m.timestamp AS timestamp, m.author_id AS author_id,
       substring(m.content, 1, 100) AS content_preview
FROM {embeddings} v JOIN {messages} m ON m.id = 'm_' || CAST(v.vec_id AS STRING)""",
    "message_clusters": """
SELECT CAST(1 AS BIGINT) AS clustering_run_id, 'm_' || CAST(v.vec_id AS STRING) AS message_id,
       CASE WHEN v.label = 9 THEN -1 ELSE v.label END AS cluster_id, CAST(1706745600 AS BIGINT) AS created_at
FROM {embeddings} v""",
    "clustering_runs": """
SELECT CAST(1 AS BIGINT) AS id, 'labels' AS method, '{"k": 10}' AS parameters,
       count(DISTINCT v.label) - 1 AS n_clusters, sum(CASE WHEN v.label = 9 THEN 1 ELSE 0 END) AS n_noise,
       count(*) AS n_samples, CAST(NULL AS DOUBLE) AS silhouette_score, CAST(NULL AS STRING) AS quality_metrics,
       CAST(1706745600 AS BIGINT) AS created_at
FROM {embeddings} v""",
}
# Shared by the checking SQL only.
_KNOWN = ", ".join(f"'{name}'" for name in TAXONOMY)
SQL_VIEWS = {
    "lab": f"SELECT DISTINCT message_id, category FROM {{message_taxonomy}} WHERE category IN ({_KNOWN})",
    "facts": "SELECT m.*, l.category FROM {messages} m JOIN {lab} l ON m.id = l.message_id",
    "nodes": "SELECT * FROM {messages} WHERE id IN (SELECT message_id FROM {message_taxonomy})",
    "reps": "SELECT DISTINCT c.id AS child_id, p.id AS parent_id FROM {nodes} c JOIN {nodes} p ON p.id = c.parent_id",
    "taxonomy": "SELECT * FROM (VALUES " + ", ".join(
        "('{}', '{}')".format(n, d.replace("'", "''")) for n, d in TAXONOMY.items()
    ) + ") t(name, description)",
    "posted": "SELECT m.id AS message_id, m.author_id AS user_id FROM {nodes} m WHERE m.author_id IN (SELECT id FROM {users})",
    "ents": "SELECT message_id, entity_type, coalesce(canonical_name, entity_name) AS name, category, confidence, context, id FROM {extracted_entities}",
    "wants": "SELECT p.user_id, e.name, count(DISTINCT e.message_id) AS n FROM {ents} e JOIN {posted} p ON p.message_id = e.message_id WHERE e.entity_type IN ('integration', 'feature') GROUP BY 1, 2",
    "author_rows": "SELECT m.id, m.content, m.platform, m.timestamp, m.source, u.username, u.message_count, t.category FROM {messages} m JOIN {message_taxonomy} t ON t.message_id = m.id JOIN {users} u ON u.id = m.author_id",
}
BASE_TABLES = ["events", "documents", "conversations", "embeddings"]


def _needs(text: str) -> list[str]:
    return [n for n in [*BASE_TABLES, *VIEWS, *SQL_VIEWS] if "{" + n + "}" in text]


_CORPORA: dict[tuple[str, str], Corpus] = {}


def base_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def spark_corpus(spark: SparkSession, folder: str) -> Corpus:
    """The corpus over one folder of test tables; everything stays lazy."""
    cached = _CORPORA.get((spark.sparkContext.applicationId, folder))
    if cached is not None:
        return cached
    frames = {name: base_table(spark, folder, name) for name in BASE_TABLES}
    for name, text in VIEWS.items():
        used = _needs(text)
        # Column names in braces belong to JSON literals, so only table markers are replaced.
        body = text.replace("{epoch}", EPOCH_SPARK)
        for table in used:
            frames[table].createOrReplaceTempView(f"cl_{table}")
            body = body.replace("{" + table + "}", f"cl_{table}")
        frames[name] = spark.sql(body)
    g = Corpus(**{name: frames[name] for name in VIEWS})
    _CORPORA[(spark.sparkContext.applicationId, folder)] = g
    return g


def duckdb_with(query: str) -> str:
    """A query over the engine's tables as one statement over the driver's views.

    Names in braces become CTEs; a query may bring its own CTEs with a leading WITH.
    """
    bodies = {**VIEWS, **SQL_VIEWS}
    wanted: list[str] = []

    def visit(text: str) -> None:
        for used in _needs(text):
            if used in bodies and used not in wanted:
                visit(bodies[used])
                wanted.append(used)

    def plain(text: str) -> str:
        text = text.replace("{epoch}", EPOCH_DUCKDB)
        for used in _needs(text):
            text = text.replace("{" + used + "}", used)
        return text.strip()

    visit(query)
    query = plain(query)
    parts = [f"{name} AS ({plain(bodies[name])})" for name in wanted]
    if query.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*parts, query[15:]])
    if query.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*parts, query[5:]])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + query
