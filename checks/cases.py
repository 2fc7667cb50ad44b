"""Every registered query beside the SQL it must equal.

``CASES`` maps a name to (build, sql): build takes (spark, folder, corpus) and
returns a DataFrame; sql is run by DuckDB on the same tables, or is None.
Arrays, maps and times are turned into text, so that both engines compare.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatterlens.functions import fixed_values as fv
from chatterlens.functions.columns import utc_timestamp
from chatterlens.operators import clusters as cl
from chatterlens.operators import enrich as en
from chatterlens.operators import graph as gr
from chatterlens.operators import ingest as ing
from chatterlens.operators import ivf
from chatterlens.operators import tables as tb
from chatterlens.operators import vectors as ve
from chatterlens.plans import explore as ex
from chatterlens.plans import questions as qu
from chatterlens.plans import reports as rp
from chatterlens.schemas import CHAT_METADATA, COMMENT_FIELDS, COMMENT_METADATA, POST_METADATA, RAW_CHAT
from chatterlens.session import ensure_checkpoint_dir, written_once
from chatterlens.sources import raw, sinks
from chatterlens.sources.corpus import Corpus, read_corpus, taxonomy_dim
from chatterlens.streaming import streams as st
from checks.adapter import base_table, duckdb_with

CASES: dict[str, tuple[Callable[[SparkSession, str, Corpus], DataFrame], str | None]] = {}
SEP = " | "
NOW = 1707000000


def case(name: str, sql: str | None = None):
    def register(build):
        CASES[name] = (build, duckdb_with(sql) if sql else None)
        return build

    return register


def flat(df: DataFrame) -> DataFrame:
    """Nested and time columns as text."""

    def as_text(field: T.StructField):
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.MapType):
            pairs = F.array_sort(F.map_entries(c))
            return F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), SEP)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            names = kind.elementType.fieldNames()
            return F.array_join(F.transform(c, lambda e: F.concat_ws("/", *[e[n].cast("string") for n in names])), SEP)
        if isinstance(kind, T.ArrayType):
            return F.array_join(c.cast("array<string>"), SEP)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        if isinstance(kind, T.DateType):
            return c.cast("string")
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint")
        return c

    return df.select(*[as_text(f).alias(f.name) for f in df.schema.fields])


def work_folder(spark: SparkSession) -> str:
    """A fresh folder for a stream's output: beside the checkpoints, which a cluster must name."""
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext.getCheckpointDir(), f"stream-{uuid.uuid4().hex}")


def pct(n: str, d: str) -> str:
    return f"floor((CAST({n} AS BIGINT) * 2000 + CAST({d} AS BIGINT)) / (2 * CAST({d} AS BIGINT))) / 10"


def pct2(n: str, d: str) -> str:
    return f"floor((CAST({n} AS BIGINT) * 20000 + CAST({d} AS BIGINT)) / (2 * CAST({d} AS BIGINT))) / 100"


def ratio(n: str, d: str) -> str:
    return f"floor((CAST({n} AS BIGINT) * 20 + CAST({d} AS BIGINT)) / (2 * CAST({d} AS BIGINT))) / 10"


def in_(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def words(names) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in sorted(set(names))) + "]"


TIME = "strftime(make_timestamp({} * 1000000), '%Y-%m-%d %H:%M:%S')".format
NEWEST = "timestamp DESC, id"

# --- 2A ingest -----------------------------------------------------------------------------------


def raw_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Chat records derived from events and documents: bots, blank texts, attachments and replies."""
    e, d = base_table(spark, folder, "events"), base_table(spark, folder, "documents")
    rows = e.join(d.select("doc_id", "text"), F.col("doc_id") == F.col("event_id"), "left")
    return rows.select(
        F.col("event_id").cast("string").alias("id"),
        F.when(F.col("event_type") == "view", 19).otherwise(0).alias("type"),
        F.when(F.col("event_type") == "click", "  \n").otherwise(F.concat(F.lit("\n "), F.coalesce("text", "props"), F.lit("\t"))).alias("content"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123000+00:00")).alias("timestamp"),
        F.lit(None).cast("string").alias("edited_timestamp"),
        F.struct(
            F.col("user_id").cast("string").alias("id"), F.concat(F.lit("name_"), "user_id").alias("username"),
            (F.col("event_type") == "error").alias("bot"),
        ).alias("author"),
        F.when(F.col("event_type") == "view", F.struct(F.floor(F.col("event_id") / 2).cast("string").alias("id"))).alias("referenced_message"),
        F.array(F.struct(F.col("user_id").cast("string").alias("id"))).alias("mentions"),
        F.lit(None).cast("array<string>").alias("mention_roles"),
        F.when(
            F.col("value") > 50,
            F.array(F.struct(F.lit("u").alias("url"), F.lit("f").alias("filename"), F.lit("image/png").alias("content_type"))),
        ).alias("attachments"),
        F.lit(None).cast("array<struct<title:string>>").alias("embeds"),
        F.array(F.struct(F.struct(F.lit("+1").alias("name")).alias("emoji"), F.lit(2).alias("count"))).alias("reactions"),
    )


@case("normalize_chat", """
SELECT 'discord_' || CAST(e.event_id AS STRING) AS id,
       CASE WHEN e.event_type = 'click' THEN '' ELSE trim(coalesce(d.text, e.props), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(12288)) END AS content,
       'discord_' || CAST(e.user_id AS STRING) AS author_id, 'name_' || CAST(e.user_id AS STRING) AS author_name,
       {epoch} AS timestamp,
       CASE WHEN e.event_type = 'view' THEN 'discord_' || CAST(CAST(floor(e.event_id / 2) AS BIGINT) AS STRING) END AS parent_id,
       CAST(CASE WHEN e.event_type = 'view' THEN 19 ELSE 0 END AS BIGINT) AS type,
       CAST(CASE WHEN e.value > 50 THEN 1 ELSE 0 END AS BIGINT) AS attachments,
       'discord_' || CAST(e.user_id AS STRING) AS mentions
FROM {events} e LEFT JOIN {documents} d ON d.doc_id = e.event_id
WHERE e.event_type <> 'error' AND (e.value > 50 OR e.event_type <> 'click')
  AND (e.value > 50 OR trim(coalesce(d.text, e.props), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(12288)) <> '')""")
def _(spark, folder, g):
    rows = raw.parse_metadata(raw.normalize_chat(raw_chat(spark, folder), "general"), CHAT_METADATA)
    return rows.select(
        "id", "content", "author_id", "author_name", "timestamp", "parent_id", F.col("parsed.type").alias("type"),
        F.size("parsed.attachments").alias("attachments"), F.array_join("parsed.mentions", ",").alias("mentions"),
    )


@case("ingest_stats", """
SELECT CASE WHEN event_type = 'error' THEN 'skipped_bots' WHEN event_type = 'click' AND value <= 50 THEN 'skipped_empty' ELSE 'kept' END AS reason,
       count(*) AS n, count(DISTINCT user_id) AS authors
FROM {events} GROUP BY 1""")
def _(spark, folder, g):
    return raw.ingest_stats(raw_chat(spark, folder), raw.drop_reason_chat(), F.col("author.id"))


def raw_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts derived from documents, with removed, empty and blank bodies and automatic authors by event type."""
    d, e = base_table(spark, folder, "documents"), base_table(spark, folder, "events")
    rows = e.join(d.select("doc_id", "text"), F.col("doc_id") == F.col("event_id"), "left")
    body = (
        F.when(F.col("event_type") == "click", "").when(F.col("event_type") == "error", "[removed]")
        .when(F.col("event_type") == "signup", " \n").otherwise(F.coalesce("text", "props"))
    )
    return rows.select(
        F.col("event_id").cast("string").alias("id"), F.concat(F.lit("Title "), "event_id").alias("title"),
        body.alias("selftext"),
        F.when(F.col("value") > 100, "RobotFan").otherwise(F.concat(F.lit("name_"), "user_id")).alias("author"),
        (F.lit(1704067200) + F.col("event_id")).cast("double").alias("created_utc"),
        F.lit(7).alias("score"), F.col("value").alias("upvote_ratio"), F.lit(1).alias("num_comments"),
        F.lit(None).cast("string").alias("link_flair_text"), F.lit(True).alias("is_self"), F.lit("u").alias("url"),
        F.concat(F.lit("/r/x/"), "event_id").alias("permalink"),
        F.array(F.struct(F.lit("gold").alias("name"))).alias("all_awardings"),
        F.lit(False).alias("stickied"), F.lit(False).alias("locked"),
    )


@case("normalize_forum_posts", """
SELECT 'reddit_t3_' || CAST(e.event_id AS STRING) AS id,
       'Title ' || CAST(e.event_id AS STRING) || CASE WHEN e.event_type = 'signup' THEN ''
         WHEN trim(coalesce(d.text, e.props), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(12288)) = '' THEN '' ELSE chr(10) || chr(10) || coalesce(d.text, e.props) END AS content,
       'reddit_name_' || CAST(e.user_id AS STRING) AS author_id, 1704067200 + e.event_id AS timestamp,
       'https://reddit.com/r/x/' || CAST(e.event_id AS STRING) AS permalink, 'gold' AS awards
FROM {events} e LEFT JOIN {documents} d ON d.doc_id = e.event_id
WHERE e.event_type NOT IN ('click', 'error') AND e.value <= 100 AND coalesce(d.text, e.props) NOT IN ('[removed]', '[deleted]', '')""")
def _(spark, folder, g):
    rows = raw.parse_metadata(raw.normalize_forum_posts(raw_posts(spark, folder), "x"), POST_METADATA)
    return rows.select("id", "content", "author_id", "timestamp", "parsed.permalink", F.array_join("parsed.awards", ",").alias("awards"))


def raw_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Comments derived from conversations: each turn replies to the turn before."""
    c = base_table(spark, folder, "conversations")
    parent = F.when(F.col("turn") == 0, F.concat(F.lit("t3_"), "conv_id")).otherwise(
        F.concat(F.lit("t1_"), "conv_id", F.lit("_"), F.col("turn") - 1)
    )
    return c.select(
        F.concat("conv_id", F.lit("_"), "turn").alias("id"), F.concat(F.lit(" "), "text", F.lit("\n")).alias("body"),
        F.when(F.col("role") == "system", "[deleted]").when(F.col("turn") == 5, "AutoModerator").otherwise(
            F.concat("role", F.lit("_"), "conv_id")
        ).alias("author"),
        parent.alias("parent_id"), (F.lit(1704067200) + F.col("conv_id") * 600 + F.col("turn") * 30).cast("double").alias("created_utc"),
        F.lit(1).alias("score"), (F.col("role") == "user").alias("is_submitter"), F.lit("/p").alias("permalink"),
        F.lit(None).cast("array<struct<name:string>>").alias("all_awardings"),
    )


@case("normalize_forum_comments", """
SELECT 'reddit_t1_' || CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING) AS id,
       trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(12288)) AS content, 'reddit_' || role || '_' || CAST(conv_id AS STRING) AS author_id,
       1704067200 + conv_id * 600 + turn * 30 AS timestamp,
       CASE WHEN turn = 0 THEN 'reddit_t3_' || CAST(conv_id AS STRING) ELSE 'reddit_t1_' || CAST(conv_id AS STRING) || '_' || CAST(turn - 1 AS STRING) END AS parent_id,
       turn = 0 AS is_top_level
FROM {conversations} WHERE role <> 'system' AND turn <> 5 AND trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(12288)) <> ''""")
def _(spark, folder, g):
    rows = raw.parse_metadata(raw.normalize_forum_comments(raw_comments(spark, folder), "x"), COMMENT_METADATA)
    return rows.select("id", "content", "author_id", "timestamp", "parent_id", "parsed.is_top_level")


@case("flatten_comment_tree", """
SELECT CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING) AS id, text AS body FROM {conversations}""")
def _(spark, folder, g):
    # Three levels: turns 3n, 3n + 1 and 3n + 2 of a conversation nest; each has at most one reply in its tree.
    c = base_table(spark, folder, "conversations").select(
        F.concat("conv_id", F.lit("_"), "turn").alias("id"), F.col("text").alias("__text"), "turn", F.struct("conv_id", F.floor(F.col("turn") / 3)).alias("tree"),
    )
    rows = raw_comments(spark, folder).join(c, "id").withColumn("body", F.col("__text"))
    fields = list(COMMENT_FIELDS)
    level = [rows.filter(F.col("turn") % 3 == k).select("tree", *fields) for k in range(3)]

    def replies(df, *more):
        return df.groupBy("tree").agg(F.collect_list(F.struct(*fields, *more)).alias("replies"))

    middle = level[1].join(replies(level[2]), "tree", "left")
    top = level[0].join(replies(middle, "replies"), "tree", "left").drop("tree")
    return raw.flatten_comment_tree(top, 3).select("id", "body")


DEPTHS = """WITH RECURSIVE up(id, anc) AS (
  SELECT m.id, p.id FROM {messages} m JOIN {messages} p ON p.id = m.parent_id
  UNION SELECT u.id, p.id FROM up u JOIN {messages} a ON a.id = u.anc JOIN {messages} p ON p.id = a.parent_id),
loops AS (SELECT DISTINCT id FROM up WHERE id = anc),
depths AS (SELECT m.id, bool_or(coalesce(u.anc IN (SELECT id FROM loops), false)) AS on_cycle, count(u.anc) AS depth FROM {messages} m LEFT JOIN up u ON u.id = m.id GROUP BY m.id)
"""


@case("comment_depth", DEPTHS + "SELECT id, CASE WHEN NOT on_cycle THEN depth END AS depth, on_cycle FROM depths")
def _(spark, folder, g):
    return ing.comment_depth(g.messages)


@case("with_comment_depth", """
WITH RECURSIVE kept AS (SELECT * FROM {conversations} WHERE role <> 'system' AND turn <> 5 AND trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(12288)) <> ''),
d(conv_id, turn, depth) AS (
  SELECT conv_id, turn, 0 FROM kept k WHERE turn = 0 OR NOT EXISTS (SELECT 1 FROM kept p WHERE p.conv_id = k.conv_id AND p.turn = k.turn - 1)
  UNION ALL SELECT k.conv_id, k.turn, d.depth + 1 FROM d JOIN kept k ON k.conv_id = d.conv_id AND k.turn = d.turn + 1)
SELECT 'reddit_t1_' || CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING) AS id, CAST(depth AS BIGINT) AS depth FROM d""")
def _(spark, folder, g):
    filled = ing.with_comment_depth(raw.normalize_forum_comments(raw_comments(spark, folder), "x"))
    return raw.parse_metadata(filled, COMMENT_METADATA).select("id", "parsed.depth")


@case("filter_bot_authors", """
SELECT id, username FROM {users} WHERE NOT (lower(username) LIKE '%bot%' OR lower(username) LIKE '%automod%' OR lower(username) LIKE '%moderator%')""")
def _(spark, folder, g):
    return raw.filter_bot_authors(g.users, "username").select("id", "username")


@case("filter_deleted", """
SELECT event_id AS id FROM (SELECT e.event_id, e.event_type,
  CASE WHEN e.event_type = 'error' THEN '[removed]' WHEN e.event_type = 'click' THEN '' ELSE e.props END AS body,
  CASE WHEN e.event_type = 'view' THEN NULL ELSE 'a' END AS author FROM {events} e)
WHERE author IS NOT NULL AND body NOT IN ('[removed]', '[deleted]', '')""")
def _(spark, folder, g):
    e = base_table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", "[removed]").when(F.col("event_type") == "click", "").otherwise(F.col("props")).alias("body"),
        F.when(F.col("event_type") == "view", None).otherwise("a").alias("author"),
    )
    return raw.filter_deleted(e, "body", "author").select("id")


@case("filter_recent_months", "SELECT id, timestamp FROM {messages} WHERE timestamp >= 1708473600 - 30 * 86400")
def _(spark, folder, g):
    return raw.filter_recent_months(g.messages, as_of=1708473600, months=1).select("id", "timestamp")


@case("dedup_insert_ignore", """
SELECT id, platform, content, scraped_at FROM {messages} WHERE id NOT IN (SELECT message_id FROM {vectors})""")
def _(spark, folder, g):
    m = g.messages.select("id", "platform", "content", "scraped_at")
    copies = m.withColumn("scraped_at", F.col("scraped_at") + 5).withColumn("content", F.concat("content", F.lit(" copy")))
    again = m.withColumn("content", F.concat("content", F.lit(" edited")))
    known = g.vectors.select(F.col("message_id").alias("id"))
    return ing.dedup_insert_ignore(copies.unionByName(again).unionByName(m), known)


@case("upsert_users", f"""
SELECT id, platform, CASE WHEN platform = 'discord' THEN username || '_new' ELSE username END AS username, message_count, first_seen,
       CASE WHEN platform = 'discord' THEN {NOW} ELSE last_seen END AS last_seen FROM {{users}}
UNION ALL
SELECT 'x_' || id, platform, username || '_new', 0, {NOW}, {NOW} FROM {{users}} WHERE platform = 'discord'""")
def _(spark, folder, g):
    renamed = g.users.filter("platform = 'discord'").withColumn("username", F.concat("username", F.lit("_new")))
    fresh = renamed.withColumn("id", F.concat(F.lit("x_"), "id"))
    last = renamed.unionByName(fresh).withColumn("place", F.lit(2))
    # Earlier updates of the same users, with names that sort before and after the last ones.
    earlier = [last.withColumn("username", F.lit(name)).withColumn("place", F.lit(k)) for k, name in enumerate(("zzz", "aaa"))]
    return ing.upsert_users(g.users, earlier[0].unionByName(last).unionByName(earlier[1]), NOW, "place").select(
        "id", "platform", "username", "message_count", "first_seen", "last_seen"
    )


@case("user_store", f"""
SELECT id, platform, username || '_c' AS username, CAST(100 AS BIGINT) AS first_seen, CAST(102 AS BIGINT) AS last_seen FROM {{users}} WHERE platform = 'discord'
UNION ALL SELECT id, platform, username || '_b', 101, 102 FROM {{users}} WHERE platform <> 'discord'""")
def _(spark, folder, g):
    """Three batches of updates, merged after two; the second one is played twice and the oldest update comes last."""
    store = ing.user_store(spark, os.path.join(work_folder(spark), "users"), max_deltas=2)
    update = lambda users, ending, place: users.withColumn("username", F.concat("username", F.lit(ending))).withColumn("place", F.lit(place))
    chat = g.users.filter("platform = 'discord'")
    ing.save_users(store, update(chat, "_c", 9), 100, "place", 0)
    for _again in range(2):
        ing.save_users(store, update(g.users, "_b", 5), 101, "place", 1)
    ing.save_users(store, update(g.users, "_a", 1), 102, "place", 2)
    return store.read().select("id", "platform", "username", "first_seen", "last_seen")


@case("insert_users_ignore", f"""
SELECT id, platform, username, message_count, first_seen, last_seen FROM {{users}}
UNION ALL
SELECT 'x_' || id, platform, username || '_new', 0, {NOW}, {NOW} FROM {{users}} WHERE platform = 'discord'""")
def _(spark, folder, g):
    renamed = g.users.filter("platform = 'discord'").withColumn("username", F.concat("username", F.lit("_new")))
    fresh = renamed.withColumn("id", F.concat(F.lit("x_"), "id"))
    return ing.insert_users_ignore(g.users, renamed.unionByName(fresh), NOW).select(
        "id", "platform", "username", "message_count", "first_seen", "last_seen"
    )


@case("user_activity_rollup", """
SELECT author_id AS id, platform, author_id AS username, count(*) AS message_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen
FROM {messages} GROUP BY author_id, platform""")
def _(spark, folder, g):
    return ing.user_activity_rollup(g.messages)


@case("validate_corpus", """
WITH m AS (SELECT id, CASE WHEN source = 'conversations' THEN 'irc' WHEN source = 'src2' THEN NULL ELSE platform END AS platform,
    CASE WHEN source = 'src1' THEN author_id || '_gone' ELSE author_id END AS author_id,
    CASE WHEN platform = 'reddit' THEN parent_id || '_gone' ELSE parent_id END AS parent_id,
    CASE WHEN source = 'src3' THEN NULL ELSE scraped_at END AS scraped_at, content, timestamp FROM {messages}),
u AS (SELECT id, CASE WHEN message_count = 1 THEN NULL ELSE username END AS username, CASE WHEN message_count = 2 THEN NULL ELSE platform END AS platform FROM {users}),
e AS (SELECT id, CASE WHEN entity_type = 'workaround' THEN 'rumour' ELSE entity_type END AS entity_type,
    CASE WHEN entity_type = 'feature' THEN message_id || '_gone' ELSE message_id END AS message_id FROM {extracted_entities}),
r AS (SELECT message_id, id FROM {embeddings_reference} UNION ALL SELECT message_id || CASE WHEN id % 2 = 0 THEN '' ELSE '_gone' END, id FROM {embeddings_reference}),
c AS (SELECT CASE WHEN cluster_id = 1 THEN 99 ELSE clustering_run_id END AS clustering_run_id, CASE WHEN cluster_id = 2 THEN message_id || '_gone' ELSE message_id END AS message_id,
    CASE WHEN cluster_id = 3 THEN NULL ELSE cluster_id END AS cluster_id FROM {message_clusters}),
t AS (SELECT CASE WHEN category = 'questions' THEN 77 ELSE taxonomy_run_id END AS taxonomy_run_id, CASE WHEN category = 'bug_reports' THEN message_id || '_gone' ELSE message_id END AS message_id FROM {message_taxonomy})
SELECT 'messages' AS "table", 'platform' AS rule, id AS key FROM m WHERE platform NOT IN ('discord', 'reddit')
UNION ALL SELECT 'messages', 'required', id FROM m WHERE platform IS NULL OR content IS NULL OR author_id IS NULL OR timestamp IS NULL OR scraped_at IS NULL
UNION ALL SELECT 'messages', 'author_exists', id FROM m WHERE author_id NOT IN (SELECT id FROM u)
UNION ALL SELECT 'messages', 'parent_exists', id FROM m WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM m)
UNION ALL SELECT 'users', 'required', id FROM u WHERE username IS NULL OR platform IS NULL
UNION ALL SELECT 'embeddings_reference', 'unique_message', message_id FROM r GROUP BY message_id HAVING count(*) > 1
UNION ALL SELECT 'embeddings_reference', 'message_exists', message_id FROM r WHERE message_id NOT IN (SELECT id FROM m)
UNION ALL SELECT 'message_clusters', 'run_exists', message_id FROM c WHERE clustering_run_id NOT IN (SELECT id FROM {clustering_runs})
UNION ALL SELECT 'message_clusters', 'message_exists', message_id FROM c WHERE message_id NOT IN (SELECT id FROM m)
UNION ALL SELECT 'message_clusters', 'required', message_id FROM c WHERE cluster_id IS NULL
UNION ALL SELECT 'message_taxonomy', 'run_exists', message_id FROM t WHERE taxonomy_run_id NOT IN (SELECT id FROM {taxonomy_runs})
UNION ALL SELECT 'message_taxonomy', 'message_exists', message_id FROM t WHERE message_id NOT IN (SELECT id FROM m)
UNION ALL SELECT 'extracted_entities', 'entity_type', CAST(id AS STRING) FROM e WHERE entity_type = 'rumour'
UNION ALL SELECT 'extracted_entities', 'message_exists', CAST(id AS STRING) FROM e WHERE message_id NOT IN (SELECT id FROM m)""")
def _(spark, folder, g):
    def spoil(df, column, where, value):
        return df.withColumn(column, F.when(F.expr(where), value).otherwise(F.col(column)))

    def gone(column):
        return F.concat(column, F.lit("_gone"))

    null = F.lit(None)
    m = spoil(g.messages, "parent_id", "platform = 'reddit'", gone("parent_id"))
    m = spoil(spoil(m, "author_id", "source = 'src1'", gone("author_id")), "platform", "source = 'conversations'", F.lit("irc"))
    # A missing source is allowed; a missing platform or time of collection is not.
    m = spoil(spoil(spoil(m, "platform", "source = 'src2'", null), "scraped_at", "source = 'src3'", null), "source", "source = 'src4'", null)
    u = spoil(spoil(g.users, "username", "message_count = 1", null), "platform", "message_count = 2", null)
    e = spoil(g.extracted_entities, "message_id", "entity_type = 'feature'", gone("message_id"))
    e = spoil(e, "entity_type", "entity_type = 'workaround'", F.lit("rumour"))
    refs = g.embeddings_reference.unionByName(spoil(g.embeddings_reference, "message_id", "id % 2 <> 0", gone("message_id")))
    c = spoil(spoil(g.message_clusters, "clustering_run_id", "cluster_id = 1", F.lit(99)), "message_id", "cluster_id = 2", gone("message_id"))
    c = spoil(c, "cluster_id", "cluster_id = 3", null)
    t = spoil(spoil(g.message_taxonomy, "taxonomy_run_id", "category = 'questions'", F.lit(77)), "message_id", "category = 'bug_reports'", gone("message_id"))
    # The parameters of the derived run are complete but for its scores.
    return ing.validate_corpus(replace(g, messages=m, users=u, extracted_entities=e, embeddings_reference=refs, message_clusters=c, message_taxonomy=t))


@case("parse_metadata", """
SELECT id, CAST(json_extract_string(metadata, '$.k') AS BIGINT) AS k, CAST(json_extract_string(metadata, '$.type') AS BIGINT) AS type,
       json_extract_string(metadata, '$.author') AS author FROM {messages}""")
def _(spark, folder, g):
    parsed = raw.parse_metadata(g.messages, "k bigint, type bigint, author string")
    return parsed.select("id", "parsed.k", "parsed.type", "parsed.author")


@case("write_csv", """
SELECT content, platform, strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M') AS date, source, username, message_count AS user_msg_count
FROM {author_rows} WHERE category = 'integration_requests'""")
def _(spark, folder, g):
    rows = sinks.message_export(tb.messages_with_author_by_category(g, ["integration_requests"]))
    path = os.path.join(work_folder(spark), "csv")
    sinks.write_csv(rows, path)
    reader = spark.read.schema(rows.schema).option("header", True).option("multiLine", True)
    return reader.option("escape", '"').option("lineSep", "\n").csv(path)


KW = words(fv.INTEGRATION_WORDS)
AUTO = "list_sort(list_filter([" + ", ".join(
    [f"CASE WHEN list_has_any(keywords, {words(c)}) THEN '{n}' END" for n, c in fv.AUTO_KEYWORD_CUES.items()]
    + ["CASE WHEN " + " OR ".join(f"contains(lower(content), '{c}')" for c in cues) + f" THEN '{n}' END" for n, cues in fv.AUTO_TEXT_CUES.items()]
) + "], lambda x: x IS NOT NULL))"
INTEGRATION = f"""ik AS (SELECT *, list_sort(list_filter({KW}, lambda w: contains(lower(content), w))) AS keywords FROM {{author_rows}} WHERE category = 'integration_requests'),
im AS (SELECT *, CASE WHEN len(autos) = 0 THEN ['uncategorized'] ELSE autos END AS auto_categories FROM (SELECT *, {AUTO} AS autos FROM ik))"""


@case("write_json", f"""
WITH {INTEGRATION}
SELECT id, content, platform, timestamp, {TIME('timestamp')} AS date, source, username, message_count AS total_messages,
       array_to_string(keywords, '{SEP}') AS extracted_keywords, array_to_string(auto_categories, '{SEP}') AS auto_categories FROM im""")
def _(spark, folder, g):
    rows = sinks.report_rows(rp.integration_messages(g, content=True))
    path = os.path.join(work_folder(spark), "json")
    sinks.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path).select("id", "content", "platform", "timestamp", "date", "source", "user.username", "user.total_messages",
                       "extracted_keywords", "auto_categories")


# --- 2B tables -----------------------------------------------------------------------------------


@case("message_by_id", "SELECT id, platform, content, author_id, timestamp FROM {messages} WHERE id = 'm_77'")
def _(spark, folder, g):
    return tb.message_by_id(g.messages, "m_77").select("id", "platform", "content", "author_id", "timestamp")


@case("messages_by_platform", f"SELECT id, content, timestamp FROM {{messages}} WHERE platform = 'reddit' ORDER BY {NEWEST} LIMIT 40 OFFSET 25")
def _(spark, folder, g):
    return tb.messages_by_platform(g.messages, "reddit", 40, 25).select("id", "content", "timestamp")


@case("messages_by_timerange", "SELECT id, platform, timestamp FROM {messages} WHERE timestamp BETWEEN 1704500000 AND 1705500000 AND platform = 'discord'")
def _(spark, folder, g):
    return tb.messages_by_timerange(g.messages, 1704500000, 1705500000, "discord").select("id", "platform", "timestamp")


@case("message_count", "SELECT count(*) AS n FROM {messages} WHERE platform = 'discord'")
def _(spark, folder, g):
    return tb.message_count(g.messages, "discord")


@case("user_by_id", "SELECT id, platform, username, message_count, first_seen, last_seen FROM {users} WHERE id = 'u_7'")
def _(spark, folder, g):
    return tb.user_by_id(g.users, "u_7").select("id", "platform", "username", "message_count", "first_seen", "last_seen")


@case("top_users_by_activity", "SELECT id, username, message_count FROM {users} ORDER BY message_count DESC, id LIMIT 50")
def _(spark, folder, g):
    return tb.top_users_by_activity(g.users).select("id", "username", "message_count")


@case("append_entity", """
WITH grown AS (SELECT message_id, entity_type, entity_name, context, false AS fresh FROM {extracted_entities}
  UNION ALL SELECT message_id, entity_type, entity_name, 'new', true FROM {extracted_entities} WHERE entity_type = 'feature')
SELECT message_id, entity_type, entity_name, context, fresh, true AS id_sound FROM grown""")
def _(spark, folder, g):
    """All old rows with their ids, and the new ones with unique ids above the last."""
    e = g.extracted_entities
    last = e.agg(F.max("id")).scalar()
    grown = tb.append_entity(e, e.filter("entity_type = 'feature'").drop("id").withColumn("context", F.lit("new")))
    grown = grown.withColumn("fresh", F.col("context") == "new")
    ids = grown.groupBy("id").agg(F.count("*").alias("uses"))
    return grown.join(ids, "id").select(
        "message_id", "entity_type", "entity_name", "context", "fresh",
        ((F.col("uses") == 1) & ((F.col("id") > last) == F.col("fresh")) & (F.col("fresh") | (F.col("message_id") == F.concat(F.lit("m_"), "id")))).alias("id_sound"))


@case("entities_by_type", "SELECT id, entity_name, confidence FROM {extracted_entities} WHERE entity_type = 'pain_point' AND (confidence IS NULL OR confidence >= 0.4)")
def _(spark, folder, g):
    return tb.entities_by_type(g.extracted_entities, "pain_point", 0.4).select("id", "entity_name", "confidence")


@case("entity_frequency", "SELECT entity_type, coalesce(canonical_name, entity_name) AS name, count(*) AS frequency FROM {extracted_entities} GROUP BY 1, 2")
def _(spark, folder, g):
    return tb.entity_frequency(g.extracted_entities)


@case("embedding_refs", """
SELECT message_id, chromadb_id, embedding_model FROM {embeddings_reference}
UNION ALL SELECT id, 'new_' || id, 'new' FROM {messages} WHERE id NOT IN (SELECT message_id FROM {embeddings_reference})""")
def _(spark, folder, g):
    incoming = g.messages.select(F.col("id").alias("message_id"), F.concat(F.lit("new_"), "id").alias("chromadb_id"))
    return tb.embedding_refs(g.embeddings_reference, incoming, "new").select("message_id", "chromadb_id", "embedding_model")


@case("messages_without_embeddings", "SELECT id, timestamp FROM {messages} WHERE length(content) >= 20 AND id NOT IN (SELECT message_id FROM {embeddings_reference})")
def _(spark, folder, g):
    return tb.messages_without_embeddings(g.messages, g.embeddings_reference).select("id", "timestamp")


@case("corpus_stats", """
SELECT 'total_messages' AS metric, '' AS key, count(*) AS value FROM {messages}
UNION ALL SELECT 'first_message', '', min(timestamp) FROM {messages} UNION ALL SELECT 'last_message', '', max(timestamp) FROM {messages}
UNION ALL SELECT 'messages_by_platform', platform, count(*) FROM {messages} GROUP BY platform
UNION ALL SELECT 'total_users', '', count(*) FROM {users} UNION ALL SELECT 'users_by_platform', platform, count(*) FROM {users} GROUP BY platform
UNION ALL SELECT 'total_entities', '', count(*) FROM {extracted_entities}
UNION ALL SELECT 'entities_by_type', entity_type, count(*) FROM {extracted_entities} GROUP BY entity_type
UNION ALL SELECT 'total_embeddings', '', count(*) FROM {embeddings_reference}""")
def _(spark, folder, g):
    return tb.corpus_stats(g)


@case("save_clustering_run", """
SELECT id, method, n_clusters::BIGINT AS n_clusters, n_noise::BIGINT AS n_noise, n_samples, silhouette_score FROM {clustering_runs}
UNION ALL SELECT 2, 'kmeans', 30, 0, (SELECT count(*) FROM {embeddings}), 0.25""")
def _(spark, folder, g):
    n = base_table(spark, folder, "embeddings").count()
    runs = tb.save_clustering_run(g.clustering_runs, "kmeans", '{"k": 30}', 30, 0, n, {"silhouette": 0.25}, NOW)
    return runs.select("id", "method", "n_clusters", "n_noise", "n_samples", "silhouette_score")


@case("save_cluster_assignments", """
SELECT CAST(1 AS BIGINT) AS clustering_run_id, 'm_' || CAST(vec_id AS STRING) AS message_id, CAST(label + 1 AS BIGINT) AS cluster_id FROM {embeddings}
UNION ALL SELECT 2, 'm_' || CAST(vec_id AS STRING), CAST(label AS BIGINT) FROM {embeddings}""")
def _(spark, folder, g):
    last = g.vectors.select("message_id", F.col("label").alias("cluster_id"), F.lit(2).alias("place"))
    labels = last.unionByName(last.withColumn("cluster_id", F.lit(99)).withColumn("place", F.lit(1)))
    second = tb.save_cluster_assignments(g.message_clusters, 2, labels, "place")
    return tb.save_cluster_assignments(second, 1, last.withColumn("cluster_id", F.col("cluster_id") + 1), "place")


@case("cluster_messages", f"""
SELECT m.id, m.content, m.timestamp FROM {{messages}} m JOIN {{message_clusters}} c ON c.message_id = m.id
WHERE c.clustering_run_id = 1 AND c.cluster_id = 3 ORDER BY {NEWEST} LIMIT 30""")
def _(spark, folder, g):
    return tb.cluster_messages(g.messages, g.message_clusters, 1, 3, 30).select("id", "content", "timestamp")


@case("clustering_run_by_id", "SELECT id, method, 'k=10' AS parameters, n_samples FROM {clustering_runs} WHERE id = 1")
def _(spark, folder, g):
    return tb.clustering_run_by_id(g.clustering_runs, 1).select("id", "method", "parameters", "n_samples")


@case("unclassified_messages", "SELECT id, content, platform, timestamp FROM {messages} WHERE length(content) >= 10 AND id NOT IN (SELECT message_id FROM {message_taxonomy})")
def _(spark, folder, g):
    return tb.unclassified_messages(g.messages, g.message_taxonomy)


@case("save_classifications", f"""
SELECT taxonomy_run_id, message_id, category, created_at FROM {{message_taxonomy}}
UNION ALL SELECT 3, id, 'questions', {NOW} FROM {{messages}} WHERE id NOT IN (SELECT message_id FROM {{message_taxonomy}})""")
def _(spark, folder, g):
    fresh = tb.unclassified_messages(g.messages, g.message_taxonomy, 0).select(
        F.col("id").alias("message_id"), F.lit("questions").alias("category")
    )
    return tb.save_classifications(g.message_taxonomy, 3, fresh, NOW).select("taxonomy_run_id", "message_id", "category", "created_at")


@case("latest_taxonomy_run", "SELECT id, model, n_messages, total_batches, processing_time_seconds, created_at FROM {taxonomy_runs} ORDER BY created_at DESC, id DESC LIMIT 1")
def _(spark, folder, g):
    return tb.latest_taxonomy_run(g.taxonomy_runs).select(
        "id", "model", "n_messages", "total_batches", "processing_time_seconds", "created_at"
    )


@case("taxonomy_run_row", f"""
SELECT CAST(1 AS BIGINT) AS id, count(*) AS n_messages, CAST(ceil(count(*) / 100.0) AS BIGINT) AS total_batches FROM {{message_taxonomy}} WHERE taxonomy_run_id = 1""")
def _(spark, folder, g):
    return tb.taxonomy_run_row(g.message_taxonomy, 1, "rules", "v1", 100, 1.5, NOW).select("id", "n_messages", "total_batches")


@case("taxonomy_breakdown", f"""
SELECT category, count(*) AS n, {pct('count(*)', 'max(r.n_messages)')} AS pct FROM {{message_taxonomy}} t JOIN {{taxonomy_runs}} r ON r.id = t.taxonomy_run_id
WHERE t.taxonomy_run_id = 1 GROUP BY category""")
def _(spark, folder, g):
    return tb.taxonomy_breakdown(g.message_taxonomy, g.taxonomy_runs.filter("id = 1"))


@case("taxonomy_samples", """
WITH big AS (SELECT category FROM {message_taxonomy} WHERE taxonomy_run_id = 1 GROUP BY category ORDER BY count(*) DESC, category LIMIT 5),
r AS (SELECT t.category, m.platform, m.content, row_number() OVER (PARTITION BY t.category ORDER BY m.timestamp DESC, m.id) AS rank
      FROM {message_taxonomy} t JOIN {messages} m ON m.id = t.message_id WHERE t.taxonomy_run_id = 1 AND t.category IN (SELECT category FROM big))
SELECT category, rank, platform, replace(substring(content, 1, 100), chr(10), ' ') AS preview FROM r WHERE rank <= 3""")
def _(spark, folder, g):
    return tb.taxonomy_samples(g.messages, g.message_taxonomy, 1)


@case("cluster_counts", "SELECT CAST(cluster_id AS BIGINT) AS cluster_id, count(*) AS n FROM {message_clusters} WHERE clustering_run_id = 1 GROUP BY 1")
def _(spark, folder, g):
    return tb.cluster_counts(g.message_clusters, 1)


@case("posts_and_comments", "SELECT id, CASE WHEN starts_with(id, 'm_') THEN 'post' ELSE 'comment' END AS kind, parent_id, split_part(content, chr(10), 1) AS first_line FROM {messages}")
def _(spark, folder, g):
    return tb.posts_and_comments(g.messages, "m_", "c_")


@case("messages_with_author_by_category", f"SELECT * FROM {{author_rows}} WHERE category IN {in_(fv.REPORT_CATEGORIES)}")
def _(spark, folder, g):
    return tb.messages_with_author_by_category(g, fv.REPORT_CATEGORIES)


# --- 2C text -------------------------------------------------------------------------------------


@case("embedding_eligible", r"""
SELECT id FROM (SELECT *, trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(12288)) AS t, coalesce(json_extract_string(metadata, '$.type'), '0') AS ty,
  lower(coalesce(json_extract_string(metadata, '$.author'), '')) AS au FROM {messages})
WHERE length(t) >= 20 AND CASE WHEN platform = 'discord' THEN ty = '0'
  ELSE NOT contains(au, 'bot') AND au <> 'automoderator' AND lower(t) NOT IN ('[removed]', '[deleted]') END""")
def _(spark, folder, g):
    return en.embedding_eligible(g.messages).select("id")


@case("embedding_cost_estimate", """
SELECT n AS text_count, n * CAST(floor(c / n / 4) AS BIGINT) AS tokens, round(n * floor(c / n / 4) / 1000000 * 0.02, 4) AS usd
FROM (SELECT count(*) AS n, sum(length(content))::BIGINT AS c FROM {messages})""")
def _(spark, folder, g):
    return en.embedding_cost_estimate(g.messages)


@case("embed_messages", """
WITH c AS (SELECT content, count(*) AS n, len(list_distinct(regexp_extract_all(lower(content), '[^\\s]+'))) AS words FROM {messages} GROUP BY content)
SELECT md5(content) AS text, n, CAST(1 AS BIGINT) AS vectors, CAST(CASE WHEN words > 0 THEN 1 ELSE 0 END AS BIGINT) AS norm, true AS narrow FROM c""")
def _(spark, folder, g):
    """Unit length, equal texts with equal vectors, and no more non-zero places than distinct words."""
    rows = en.embed_hashed(g.messages, 64).join(g.messages.select(F.col("id").alias("message_id"), "content"), "message_id")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    words = F.size(F.array_distinct(F.filter(F.split(F.lower("content"), "\\s+"), lambda w: w != "")))
    used = F.size(F.filter("embedding", lambda x: x != 0))
    return rows.groupBy(F.md5("content").alias("text")).agg(
        F.count("*").alias("n"), F.count_distinct(F.col("embedding").cast("string")).alias("vectors"),
        F.round(F.max(norm)).cast("bigint").alias("norm"), F.bool_and(used <= words).alias("narrow"))


@case("embed_with_provider", "SELECT id AS message_id, CAST(2 AS BIGINT) AS dims, CAST(length(content) AS DOUBLE) AS first, CASE WHEN platform = 'irc' THEN 'failed' ELSE 'ok' END AS status FROM {messages}")
def _(spark, folder, g):
    made = en.embed_messages(g.messages, lambda texts: [[float(len(t)), 1.0] for t in texts])
    return made.select("message_id", F.size("embedding").alias("dims"), F.col("embedding")[0].cast("double").alias("first"), "status")


@case("embed_and_store", """
WITH e AS (SELECT id, content FROM {messages} WHERE length(content) >= 20 AND id NOT IN (SELECT message_id FROM {embeddings_reference}))
SELECT 'vectors' AS part, (SELECT count(*) FROM {vectors}) + (SELECT count(*) FROM e WHERE content NOT LIKE '%Stripe%') AS n
UNION ALL SELECT 'references', (SELECT count(*) FROM {embeddings_reference}) + (SELECT count(*) FROM e WHERE content NOT LIKE '%Stripe%')
UNION ALL SELECT 'failed', (SELECT count(*) FROM e WHERE content LIKE '%Stripe%')""")
def _(spark, folder, g):
    def provider(texts):
        if any("Stripe" in t for t in texts):
            raise RuntimeError("no service")
        return [[1.0] * 64 for _ in texts]

    eligible = g.messages.filter(F.length("content") >= 20)
    stored = en.embed_and_store(eligible, g.vectors, g.embeddings_reference, provider, 64, "model", NOW, batch_size=1, retries=1)
    counts = [df.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, df in zip(("vectors", "references", "failed"), stored)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@case("vector_metadata", "SELECT id AS message_id, platform, source, timestamp, author_id, substring(content, 1, 100) AS content_preview FROM {messages}")
def _(spark, folder, g):
    return en.vector_metadata(g.messages)


@case("classification_payload", r"""
WITH b AS (SELECT id, '"' || id || '": "' || replace(replace(substring(content, 1, 500), '"', '\"'), chr(10), ' ') || '"' AS line,
  CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) % greatest(CAST(ceil((SELECT count(*) FROM {messages}) / 5000.0) AS BIGINT), 1) AS bucket FROM {messages}),
n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY id) AS row FROM b)
SELECT CAST(bucket AS STRING) || '-' || CAST(CAST(floor((row - 1) / 100) AS BIGINT) AS STRING) AS batch_id, count(*) AS n, string_agg(line, chr(10) ORDER BY id) AS payload
FROM n GROUP BY 1""")
def _(spark, folder, g):
    return en.classification_payload(g.messages)


@case("classify_messages", """
SELECT id AS message_id, CASE WHEN contains(substring(content, 1, 500), '?') THEN 'questions' ELSE 'spam_noise' END AS category FROM {messages}""")
def _(spark, folder, g):
    return en.classify_messages(g.messages, lambda texts: {k: "questions" if "?" in v else "spam_noise" for k, v in texts.items()})


RULES = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(t, '{c}')" for c in cues) + f" THEN '{name}'" for name, cues in fv.CLASSIFICATION_RULES
) + f" ELSE '{fv.FALLBACK_CATEGORY}' END"


@case("classify_by_rules", f"SELECT id AS message_id, {RULES} AS category FROM (SELECT id, lower(content) AS t FROM {{messages}})")
def _(spark, folder, g):
    return en.classify_by_rules(g.messages)


@case("parse_classifications", """
SELECT message_id, CASE WHEN category = 'questions' THEN 'other' ELSE category END AS category, category <> 'questions' AS valid
FROM {message_taxonomy} WHERE category <> 'spam_noise'""")
def _(spark, folder, g):
    category = F.when(F.col("category") == "questions", "other").otherwise(F.col("category"))
    text = F.concat(F.lit('{"'), "message_id", F.lit('": "'), category, F.when(F.col("category") == "spam_noise", "").otherwise('"}'))
    return en.parse_classifications(g.message_taxonomy.select(text.alias("response")))


@case("taxonomy_dim", "SELECT t.name, t.description, m.taxonomy_run_id, count(*) AS n FROM {taxonomy} t JOIN {message_taxonomy} m ON m.category = t.name GROUP BY 1, 2, 3")
def _(spark, folder, g):
    labels = g.message_taxonomy.groupBy(F.col("category").alias("name"), "taxonomy_run_id").agg(F.count("*").alias("n"))
    return taxonomy_dim(spark).join(labels, "name").select("name", "description", "taxonomy_run_id", "n")


@case("extract_keywords", f"SELECT id, array_to_string(list_sort(list_filter({KW}, lambda w: contains(t, w))), '{SEP}') AS keywords FROM (SELECT id, lower(content) AS t FROM {{messages}})")
def _(spark, folder, g):
    return en.extract_keywords(g.messages).select("id", "keywords")


TOOLS, PAINS = words(fv.TOOL_WORDS), words(fv.PAIN_WORDS)


def keyword_rows(source: str) -> str:
    return (
        f"kt AS (SELECT *, lower(content) AS t FROM {source}), "
        f"kl AS (SELECT *, list_filter({TOOLS}, lambda w: contains(t, w)) AS tools, list_filter({PAINS}, lambda w: contains(t, w)) AS pain_points FROM kt), "
        'kw AS (SELECT *, list_concat(tools, pain_points) AS "all" FROM kl)'
    )


REPORT_ROWS = f"(SELECT * FROM {{author_rows}} WHERE category IN {in_(fv.REPORT_CATEGORIES)})"
KEYWORDS = keyword_rows(REPORT_ROWS)
THEME_VALUES = "(VALUES " + ", ".join(f"('{n}', {words(w)})" for n, w in fv.THEMES.items()) + ") th(theme, cues)"
THEMES = KEYWORDS + f', tm AS (SELECT kw.*, th.theme FROM kw JOIN {THEME_VALUES} ON list_has_any(kw."all", th.cues))'


@case("extract_tools_and_pains", f"""
WITH {keyword_rows('{messages}')}
SELECT id, array_to_string(tools, '{SEP}') AS tools, array_to_string(pain_points, '{SEP}') AS pain_points, array_to_string("all", '{SEP}') AS "all" FROM kw""")
def _(spark, folder, g):
    return en.extract_tools_and_pains(g.messages).select("id", "tools", "pain_points", "all")


@case("auto_categories", f"WITH {INTEGRATION} SELECT id, array_to_string(auto_categories, '{SEP}') AS auto_categories FROM im")
def _(spark, folder, g):
    return rp.integration_messages(g).select("id", "auto_categories")


CROSS = (KEYWORDS + ', kc AS (SELECT keyword, category, count(*) AS n FROM (SELECT unnest("all") AS keyword, category FROM kw) GROUP BY 1, 2), '
         f"cross_kw AS (SELECT keyword, sum(n)::BIGINT AS total_mentions, count(*) AS category_count, string_agg(category || '=' || CAST(n AS STRING), '{SEP}' ORDER BY category) AS breakdown "
         "FROM kc GROUP BY keyword HAVING count(*) >= 3)")


@case("cross_category_keywords", f"WITH {CROSS} SELECT * FROM cross_kw")
def _(spark, folder, g):
    return en.cross_category_keywords(rp.keyword_messages(g))


@case("opportunity_themes", f"""
WITH {THEMES}
SELECT theme, count(*) AS messages, count(DISTINCT username) AS users, array_to_string(list_sort(list(DISTINCT category)), '{SEP}') AS categories FROM tm GROUP BY theme""")
def _(spark, folder, g):
    return en.opportunity_themes(rp.keyword_messages(g))


TOP_WORDS = THEMES + (', tw AS (SELECT theme, keyword, count(*) AS n FROM (SELECT theme, unnest(list_distinct("all")) AS keyword FROM tm) GROUP BY 1, 2), '
                      "tr AS (SELECT theme, row_number() OVER (PARTITION BY theme ORDER BY n DESC, keyword) AS rank, keyword, n FROM tw)")


@case("theme_top_keywords", f"WITH {TOP_WORDS} SELECT * FROM tr WHERE rank <= 20")
def _(spark, folder, g):
    return en.theme_top_keywords(rp.keyword_messages(g))


@case("run_throughput", """
SELECT event_type AS run_id, sum(CASE WHEN value > 50 THEN user_id ELSE 0 END)::BIGINT AS processed, sum(CASE WHEN value > 50 THEN 0 ELSE user_id END)::BIGINT AS failed,
  sum(CASE WHEN value > 50 THEN user_id ELSE 0 END)::BIGINT / (max(event_id) + 10 - min(event_id)) AS per_second FROM {events} GROUP BY 1""")
def _(spark, folder, g):
    batches = base_table(spark, folder, "events").select(
        F.col("event_type").alias("run_id"), F.col("user_id").alias("n"), F.when(F.col("value") > 50, "ok").otherwise("failed").alias("status"),
        F.col("event_id").alias("started_at"), (F.col("event_id") + 10).alias("finished_at"),
    )
    return en.run_throughput(batches)


# --- 2D vectors ----------------------------------------------------------------------------------

DIST = "round(list_sum(list_transform(list_zip(v.embedding, q.e), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2)), 6)"


def near(where: str = "true", k: int = 10, ids: str = "('m_0')") -> str:
    return f"""
WITH q AS (SELECT message_id AS query_id, embedding AS e FROM {{vectors}} WHERE message_id IN {ids}),
d AS (SELECT q.query_id, v.message_id, {DIST} AS distance, v.content_preview FROM {{vectors}} v JOIN q ON true WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, message_id) AS rank FROM d)
SELECT query_id, rank, message_id, distance, content_preview FROM r WHERE rank <= {k}"""


def found(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "message_id", F.round("distance", 6).alias("distance"), "content_preview")


def query_of(g: Corpus, *ids: str) -> dict:
    return {i: ve.stored_vector(g.vectors, i) for i in ids}


@case("vector_search", near(ids="('m_0', 'm_7')"))
def _(spark, folder, g):
    return found(ve.vector_search(g.vectors, query_of(g, "m_0", "m_7"), 10))


@case("similar_to_message", near("v.message_id <> 'm_0'"))
def _(spark, folder, g):
    return found(ve.similar_to_message(g.vectors, "m_0", 10))


@case("search_by_platform", near("v.platform = 'reddit'"))
def _(spark, folder, g):
    return found(ve.search_by_platform(g.vectors, query_of(g, "m_0"), "reddit", 10))


@case("search_by_timerange", near("v.timestamp BETWEEN 1704067200 AND 1704100000"))
def _(spark, folder, g):
    return found(ve.search_by_timerange(g.vectors, query_of(g, "m_0"), 1704067200, 1704100000, 10))


@case("search_filtered", near("v.platform = 'discord' AND contains(v.content_preview, 'the')", 5))
def _(spark, folder, g):
    return found(ve.search_filtered(g.vectors, query_of(g, "m_0"), F.col("platform") == "discord", "the", 5))


@case("vector_search_approx", """
WITH v AS (SELECT message_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM {vectors}),
d AS (SELECT q.message_id AS query_id, v.message_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) ** 2)) AS distance
  FROM v q, v WHERE CAST(substring(q.message_id, 3) AS BIGINT) % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, message_id) AS rank FROM d),
t AS (SELECT query_id, count(*) FILTER (rank <= 10) AS k FROM r GROUP BY query_id)
SELECT query_id, k AS found, true AS recall_reached, 40 * 5 < (SELECT count(*) FROM v) AS few_vectors_read,
       (SELECT round(sum(distance), 6) FROM r x WHERE x.query_id = t.query_id AND rank <= 5) AS nearest_five FROM t""")
def _(spark, folder, g):
    """Every vector whose id is divisible by 50 against all: recall of at least 0.9, and 40 whole vectors read per query."""
    index = ivf.build_inverted_file(g.vectors, work_folder(spark), pivots=16)
    queries = g.vectors.filter("CAST(substring(message_id, 3) AS BIGINT) % 50 = 0").select(F.col("message_id").alias("query_id"), "embedding")
    near = written_once(ivf.search_inverted(index, queries, 10, refine=4))
    exact = ve.vector_search(g.vectors, {r["query_id"]: r["embedding"] for r in queries.collect()}, 10).select("query_id", "message_id", F.lit(True).alias("true_one"))
    total = g.vectors.count()
    return near.join(exact, ["query_id", "message_id"], "left").groupBy("query_id").agg(
        F.count("*").alias("found"), (F.count("true_one") >= 0.9 * F.count("*")).alias("recall_reached"), F.lit(40 * 5 < total).alias("few_vectors_read"),
        F.round(F.sum(F.when(F.col("rank") <= 5, F.col("distance"))), 6).alias("nearest_five"))


@case("search_text", """
SELECT 'q' AS query_id, id AS message_id, rank FROM (
  SELECT id, row_number() OVER (ORDER BY id) AS rank FROM {messages} WHERE content = (SELECT content FROM {messages} WHERE id = 'm_0')) WHERE rank <= 1""")
def _(spark, folder, g):
    """The text of a message finds the first message with that text."""
    vectors = en.embed_hashed(g.messages, 64)
    text = g.messages.filter("id = 'm_0'").select("content").first()[0]
    return ve.search_text(vectors, {"q": text}, lambda texts: en.embed_texts(spark, texts, 64), 1).select("query_id", "message_id", F.col("rank").cast("bigint").alias("rank"))


@case("add_vectors", """
WITH v AS (SELECT 'm_' || CAST(vec_id AS STRING) AS message_id, embedding AS e FROM {embeddings} UNION ALL SELECT 'n_' || CAST(vec_id AS STRING), embedding FROM {embeddings})
SELECT message_id, CAST(len(e) AS BIGINT) AS dims, CAST(e[1] AS DOUBLE) AS first, CAST(e[64] AS DOUBLE) AS last FROM v""")
def _(spark, folder, g):
    v = g.vectors.select("message_id", "embedding")
    fresh = v.withColumn("message_id", F.replace("message_id", F.lit("m_"), F.lit("n_")))
    # The ids that are known come with other vectors, which must not replace the stored ones.
    changed = v.withColumn("embedding", F.transform("embedding", lambda x: x + 1))
    rows = ve.add_vectors(v, changed.unionByName(fresh).unionByName(fresh), 64)
    value = lambda i: F.element_at("embedding", i).cast("double")
    return rows.select("message_id", F.size("embedding").alias("dims"), value(1).alias("first"), value(64).alias("last"))


@case("vector_exists", "SELECT count(*) > 0 AS exists FROM {vectors} WHERE message_id = 'm_3'")
def _(spark, folder, g):
    return ve.vector_exists(g.vectors, "m_3")


@case("missing_vector_ids", "SELECT id FROM {messages} WHERE id NOT IN (SELECT message_id FROM {vectors})")
def _(spark, folder, g):
    return ve.missing_vector_ids(g.vectors, g.messages)


@case("delete_vectors", "SELECT message_id FROM {vectors} WHERE message_id NOT IN (SELECT id FROM {messages} WHERE platform = 'reddit')")
def _(spark, folder, g):
    return ve.delete_vectors(g.vectors, g.messages.filter("platform = 'reddit'")).select("message_id")


@case("reset_vectors", "SELECT count(*) AS added_again, CAST(0 AS BIGINT) AS left_over FROM {vectors}")
def _(spark, folder, g):
    """Nothing is left, and what is added to the emptied table is all there."""
    v = g.vectors.select("message_id", "embedding")
    emptied = ve.reset_vectors(v)
    return ve.add_vectors(emptied, v, 64).agg(F.count("*").alias("added_again")).withColumn("left_over", F.lit(emptied.count()).cast("bigint"))


@case("vector_stats", "SELECT count(*) AS n, CAST(max(len(embedding)) AS BIGINT) AS dims FROM {vectors}")
def _(spark, folder, g):
    return ve.vector_stats(g.vectors)


# --- 2E clusters ---------------------------------------------------------------------------------

UNIT = """u AS (SELECT message_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / norm) AS e
  FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM {vectors})),
x AS (SELECT message_id, label, unnest(e) AS val, generate_subscripts(e, 1) AS dim FROM u)"""


def labelled(g: Corpus) -> DataFrame:
    return g.vectors.select("message_id", "embedding", F.col("label").alias("cluster_id"))


def with_noise(g: Corpus) -> DataFrame:
    return g.message_clusters.filter("clustering_run_id = 1").select("message_id", "cluster_id")


@case("l2_normalize", f"WITH {UNIT} SELECT message_id, CAST(dim AS BIGINT) AS dim, round(val, 6) AS value FROM x")
def _(spark, folder, g):
    unit = cl.l2_normalize(g.vectors.select("message_id", "embedding"))
    return unit.select("message_id", F.posexplode("embedding").alias("dim", "value")).select(
        "message_id", (F.col("dim") + 1).alias("dim"), F.round("value", 6).alias("value")
    )


@case("cluster_kmeans", "SELECT count(*) AS n, count(DISTINCT message_id) AS ids, CAST(10 AS BIGINT) AS clusters, true AS in_range, true AS settled, true AS inertia_sound FROM {vectors}")
def _(spark, folder, g):
    """What must hold for any fit: every id once, labels in range, hardly a vector nearer to another cluster's centre, and a sound inertia."""
    labels, inertia = cl.cluster_kmeans(g.vectors, k=10, n_init=3, max_iter=100)
    unit = cl.l2_normalize(g.vectors.select("message_id", "embedding")).join(labels, "message_id")
    x = unit.select("message_id", "cluster_id", F.posexplode("embedding").alias("dim", "x")).cache()
    centres = x.groupBy("cluster_id", "dim").agg(F.avg("x").alias("mu"))
    gaps = x.join(centres.withColumnRenamed("cluster_id", "other"), "dim").groupBy("message_id", "cluster_id", "other").agg(
        F.sum((F.col("x") - F.col("mu")) ** 2).alias("d"))
    per = gaps.groupBy("message_id", "cluster_id").agg(
        F.min("d").alias("best"), F.max(F.when(F.col("other") == F.col("cluster_id"), F.col("d"))).alias("own"))
    grand = x.groupBy("dim").agg(F.avg("x").alias("mu"))
    total = x.join(grand, "dim").agg(F.sum((F.col("x") - F.col("mu")) ** 2).alias("total"))
    # Inertia is taken to the centres the fit assigned to; those of the final members can only be nearer.
    return per.agg(
        F.count("*").alias("n"), F.count_distinct("message_id").alias("ids"), F.count_distinct("cluster_id").alias("clusters"),
        F.bool_and(F.col("cluster_id").between(0, 9)).alias("in_range"),
        (F.avg((F.col("own") <= F.col("best") + 1e-6).cast("double")) > 0.99).alias("settled"), F.sum("own").alias("within"),
    ).join(total).select(
        "n", "ids", "clusters", "in_range", "settled",
        ((F.col("within") <= F.lit(inertia) + 1e-4) & (F.lit(inertia) < F.col("total") * 1.01)).alias("inertia_sound"))


@case("compare_k_values", "SELECT * FROM (VALUES (5, true, true, true, true), (10, true, true, true, true)) t(k, silhouette_sound, ch_sound, db_sound, falls)")
def _(spark, folder, g):
    """One row per k, scores in their ranges, and an inertia that falls as k grows."""
    rows = cl.compare_k_values(g.vectors, ks=(5, 10), n_init=2)
    before = F.lag("inertia", 1, float("inf")).over(Window.orderBy("k"))
    return rows.select(
        F.col("k").cast("bigint").alias("k"), F.col("silhouette").between(-1, 1).alias("silhouette_sound"), (F.col("calinski_harabasz") > 0).alias("ch_sound"),
        (F.col("davies_bouldin") > 0).alias("db_sound"), (F.col("inertia") < before).alias("falls"))


PAIRWISE = f"""WITH {UNIT},
p AS (SELECT a.message_id, a.label AS own, b.label AS other, {{gap}} AS d FROM u a JOIN u b ON a.message_id <> b.message_id),
m AS (SELECT message_id, own, other, avg(d) AS d FROM p GROUP BY 1, 2, 3),
s AS (SELECT message_id, min(CASE WHEN own = other THEN d END) AS a, min(CASE WHEN own <> other THEN d END) AS b FROM m GROUP BY 1)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s"""


@case("silhouette", PAIRWISE.replace("{gap}", "1 - list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))"))
def _(spark, folder, g):
    return cl.silhouette(labelled(g)).select(F.round("silhouette", 6).alias("silhouette"))


@case("silhouette_euclidean", PAIRWISE.replace("{gap}", "list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) ** 2))"))
def _(spark, folder, g):
    return cl.silhouette(labelled(g), "squaredEuclidean").select(F.round("silhouette", 6).alias("silhouette"))


CENTRES = UNIT + """, c AS (SELECT label, dim, avg(val) AS mu, count(*) AS n FROM x GROUP BY 1, 2), t AS (SELECT dim, avg(val) AS mu FROM x GROUP BY 1)"""


@case("calinski_harabasz", f"""WITH {CENTRES}
SELECT round((SELECT sum(c.n * (c.mu - t.mu) ** 2) FROM c JOIN t USING (dim)) / (SELECT count(DISTINCT label) - 1 FROM u)
  / ((SELECT sum((x.val - c.mu) ** 2) FROM x JOIN c USING (label, dim)) / (SELECT count(*) - count(DISTINCT label) FROM u)), 6) AS calinski_harabasz""")
def _(spark, folder, g):
    return cl.calinski_harabasz(labelled(g)).select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@case("davies_bouldin", f"""WITH {CENTRES},
s AS (SELECT label, avg(d) AS s FROM (SELECT x.message_id, x.label, sqrt(sum((x.val - c.mu) ** 2)) AS d FROM x JOIN c USING (label, dim) GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.mu - b.mu) ** 2)) AS d FROM c a JOIN c b ON a.dim = b.dim AND a.label <> b.label GROUP BY 1, 2)
SELECT round(avg(w), 6) AS davies_bouldin FROM (SELECT m.i, max((a.s + b.s) / m.d) AS w FROM m JOIN s a ON a.label = m.i JOIN s b ON b.label = m.j GROUP BY 1)""")
def _(spark, folder, g):
    return cl.davies_bouldin(labelled(g)).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@case("cluster_sizes", "SELECT CAST(cluster_id AS BIGINT) AS cluster_id, count(*) AS n FROM {message_clusters} WHERE cluster_id <> -1 GROUP BY 1")
def _(spark, folder, g):
    return cl.cluster_sizes(with_noise(g))


@case("cluster_totals", "SELECT count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS n_clusters, sum(CASE WHEN cluster_id = -1 THEN 1 ELSE 0 END)::BIGINT AS n_noise, count(*) AS n_samples FROM {message_clusters}")
def _(spark, folder, g):
    return cl.cluster_totals(with_noise(g))


@case("cluster_samples", """
WITH r AS (SELECT c.cluster_id, c.message_id, count(*) OVER (PARTITION BY c.cluster_id) AS size,
  row_number() OVER (PARTITION BY c.cluster_id ORDER BY md5(c.message_id || '42'), c.message_id) AS rank FROM {message_clusters} c WHERE c.cluster_id <> -1)
SELECT CAST(r.cluster_id AS BIGINT) AS cluster_id, r.size, r.rank, m.id, m.platform, m.source, substring(m.content, 1, 200) AS preview FROM r JOIN {messages} m ON m.id = r.message_id WHERE r.rank <= 5""")
def _(spark, folder, g):
    return cl.cluster_samples(with_noise(g), g.messages)


@case("noise_report", f"""
WITH r AS (SELECT CASE WHEN cluster_id = -1 THEN 'noise' ELSE 'clustered' END AS side, message_id FROM {{message_clusters}}),
c AS (SELECT side, count(*) AS n FROM r GROUP BY side),
s AS (SELECT r.side, m.id, m.content, row_number() OVER (PARTITION BY r.side ORDER BY m.timestamp DESC, m.id) AS rank FROM r JOIN {{messages}} m ON m.id = r.message_id)
SELECT c.side, c.n, {pct('c.n', '(SELECT count(*) FROM r)')} AS pct, s.rank, s.id, substring(s.content, 1, 200) AS preview FROM c JOIN s USING (side) WHERE s.rank <= 10""")
def _(spark, folder, g):
    return cl.noise_report(with_noise(g), g.messages)


@case("cluster_members", "SELECT CAST(c.cluster_id AS BIGINT) AS cluster_id, m.id, substring(m.content, 1, 200) AS preview FROM {message_clusters} c JOIN {messages} m ON m.id = c.message_id WHERE c.cluster_id <> -1")
def _(spark, folder, g):
    return cl.cluster_members(with_noise(g), g.messages)


@case("cluster_within_category", """
WITH p AS (SELECT DISTINCT v.message_id, t.category, v.embedding FROM {vectors} v JOIN {lab} t ON t.message_id = v.message_id)
SELECT category, count(*) AS n, least(count(DISTINCT embedding), 3) AS k, true AS in_range FROM p GROUP BY 1""")
def _(spark, folder, g):
    """Per category: every member once, and labels within the number of clusters used."""
    rows = cl.cluster_within_category(g.vectors, g.message_taxonomy, list(g.categories), k=3, n_init=1)
    return rows.groupBy("category", "k").agg(
        F.count_distinct("message_id").alias("n"), (F.bool_and(F.col("cluster_id") < F.col("k")) & (F.count("*") == F.count_distinct("message_id"))).alias("in_range"))


# --- 2F graph ------------------------------------------------------------------------------------


@case("category_nodes", "SELECT t.name, t.description, count(m.category) AS message_count FROM {taxonomy} t LEFT JOIN {message_taxonomy} m ON m.category = t.name GROUP BY 1, 2")
def _(spark, folder, g):
    return gr.category_nodes(g)


@case("user_nodes", "SELECT id, platform, username, message_count, first_seen, last_seen FROM {users}")
def _(spark, folder, g):
    return gr.user_nodes(g).drop("display_name")


@case("message_nodes", """
SELECT m.id, m.platform, m.content, m.author_id, m.timestamp, m.source, m.parent_id, t.category FROM {messages} m
JOIN (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY taxonomy_run_id DESC, created_at DESC, category DESC) AS rn FROM {message_taxonomy}) t ON t.message_id = m.id AND t.rn = 1""")
def _(spark, folder, g):
    return gr.message_nodes(g)


@case("entity_nodes", """
SELECT 'Integration' AS label, name, arg_max(category, id) AS category, count(*) AS frequency, CAST(0 AS DOUBLE) AS severity FROM {ents} WHERE entity_type = 'integration' GROUP BY name""")
def _(spark, folder, g):
    return gr.entity_nodes(g.extracted_entities, "integration", "Integration")


@case("posted_edges", "SELECT user_id, message_id FROM {posted}")
def _(spark, folder, g):
    return gr.posted_edges(g)


@case("classified_as_edges", "SELECT message_id, category FROM {lab} WHERE message_id IN (SELECT id FROM {messages})")
def _(spark, folder, g):
    return gr.classified_as_edges(g)


@case("replies_to_edges", "SELECT child_id, parent_id FROM {reps}")
def _(spark, folder, g):
    return gr.replies_to_edges(g)


@case("entity_edges", """
SELECT message_id, name AS entity_name, arg_max(confidence, id) FILTER (WHERE true) AS confidence, arg_max(context, id) AS context
FROM {ents} WHERE entity_type = 'feature' AND confidence IS NOT NULL AND message_id IN (SELECT id FROM {nodes}) GROUP BY 1, 2
UNION ALL SELECT message_id, name, NULL, context FROM {ents} WHERE entity_type = 'feature' AND confidence IS NULL AND message_id IN (SELECT id FROM {nodes})""")
def _(spark, folder, g):
    return gr.entity_edges(g, "feature")


@case("category_recount", "SELECT t.name, count(f.id) AS message_count FROM {taxonomy} t LEFT JOIN {facts} f ON f.category = t.name GROUP BY 1")
def _(spark, folder, g):
    return gr.category_recount(g)


@case("graph_stats", f"""
WITH s AS (SELECT 'node' AS kind, 'Category' AS key, count(*) AS n FROM {{taxonomy}} UNION ALL SELECT 'node', 'User', count(*) FROM {{users}}
UNION ALL SELECT 'node', 'Message', count(*) FROM {{nodes}} UNION ALL SELECT 'edge', 'POSTED', count(*) FROM {{posted}}
UNION ALL SELECT 'edge', 'CLASSIFIED_AS', count(*) FROM {{facts}} UNION ALL SELECT 'edge', 'REPLIES_TO', count(*) FROM {{reps}}
UNION ALL SELECT 'category', category, count(*) FROM {{facts}} GROUP BY category UNION ALL SELECT 'platform', platform, count(*) FROM {{nodes}} GROUP BY platform)
SELECT kind, key, n, CASE WHEN kind = 'category' THEN {pct('n', '(SELECT count(*) FROM {nodes})')} END AS pct FROM s""")
def _(spark, folder, g):
    return gr.graph_stats(g)


@case("user_message_counts", "SELECT u.username, count(*) AS n FROM {nodes} m JOIN {users} u ON u.id = m.author_id GROUP BY 1")
def _(spark, folder, g):
    return gr.user_message_counts(g)


@case("integration_request_counts", "SELECT name, count(DISTINCT message_id) AS n FROM {ents} WHERE entity_type = 'integration' AND message_id IN (SELECT id FROM {nodes}) GROUP BY 1 ORDER BY n DESC, name LIMIT 5")
def _(spark, folder, g):
    return gr.integration_request_counts(g)


@case("pain_points_by_confidence", "SELECT name, confidence, context, message_id FROM {ents} WHERE entity_type = 'pain_point' AND message_id IN (SELECT id FROM {nodes})")
def _(spark, folder, g):
    return gr.pain_points_by_confidence(g)


@case("entity_mentions_top", """
SELECT e.name, count(DISTINCT e.message_id) AS request_count, count(DISTINCT p.user_id) AS unique_users FROM {ents} e JOIN {posted} p ON p.message_id = e.message_id
WHERE e.entity_type = 'integration' GROUP BY 1 ORDER BY request_count DESC, e.name LIMIT 20""")
def _(spark, folder, g):
    return gr.entity_mentions_top(g)


@case("user_wants", "SELECT user_id, name, n FROM {wants}")
def _(spark, folder, g):
    return gr.user_wants(g)


@case("co_requested", """
WITH s AS (SELECT name, count(*) AS size FROM {wants} GROUP BY name),
p AS (SELECT x.name AS a, y.name AS b, count(*) AS n FROM {wants} x JOIN {wants} y ON x.user_id = y.user_id AND x.name < y.name GROUP BY 1, 2)
SELECT a, b, n, round(n / (sa.size + sb.size - n), 9) AS strength FROM p JOIN s sa ON sa.name = a JOIN s sb ON sb.name = b WHERE n / (sa.size + sb.size - n) > 0.3 AND n >= 2""")
def _(spark, folder, g):
    return gr.co_requested(g).withColumn("strength", F.round("strength", 9))


@case("similar_users", """
WITH c AS (SELECT DISTINCT f.author_id AS u, f.category FROM {facts} f WHERE f.author_id IN (SELECT id FROM {users})),
s AS (SELECT u, count(*) AS size FROM c GROUP BY u),
p AS (SELECT x.u AS a, y.u AS b, count(*) AS n FROM c x JOIN c y ON x.category = y.category AND x.u < y.u GROUP BY 1, 2)
SELECT a, b, round(n / (sa.size + sb.size - n), 9) AS score FROM p JOIN s sa ON sa.u = a JOIN s sb ON sb.u = b
WHERE n / (sa.size + sb.size - n) > 0.5 ORDER BY n / (sa.size + sb.size - n) DESC, a, b LIMIT 50""")
def _(spark, folder, g):
    return gr.similar_users(g).withColumn("score", F.round("score", 9))


# --- 2G questions --------------------------------------------------------------------------------


def by_user(category: str, k: int, samples: int, name: str, with_pct: bool = False) -> str:
    share = f", {pct('c.n', 'c.message_count')} AS pct" if with_pct else ""
    return f"""
WITH c AS (SELECT u.id, u.username, u.platform, u.message_count, count(*) AS n FROM {{facts}} f JOIN {{users}} u ON u.id = f.author_id
  WHERE f.category = '{category}' AND u.message_count > 0 GROUP BY 1, 2, 3, 4 ORDER BY n DESC, u.id LIMIT {k}),
s AS (SELECT author_id, content, row_number() OVER (PARTITION BY author_id ORDER BY {NEWEST}) AS rn FROM {{facts}} WHERE category = '{category}')
SELECT c.username, c.platform, c.n AS {name}, c.message_count AS total_messages{share}, string_agg(s.content, '{SEP}' ORDER BY s.rn) AS samples
FROM c JOIN s ON s.author_id = c.id AND s.rn <= {samples} GROUP BY c.id, c.username, c.platform, c.n, c.message_count"""


@case("top_complainers", by_user("pricing_complaints", 20, 3, "complaints", True))
def _(spark, folder, g):
    return qu.top_complainers(g)


@case("top_integration_requesters", by_user("integration_requests", 20, 3, "n"))
def _(spark, folder, g):
    return qu.top_integration_requesters(g)


@case("serial_bug_reporters", by_user("bug_reports", 20, 3, "n"))
def _(spark, folder, g):
    return qu.serial_bug_reporters(g)


MULTI = f"""SELECT f.author_id, array_to_string(list_sort(list(DISTINCT f.category)), '{SEP}') AS types, count(*) AS total, count(DISTINCT f.category) AS n_types
FROM {{facts}} f WHERE f.category IN {in_(fv.COMPLAINT_CATEGORIES)} GROUP BY 1 HAVING count(DISTINCT f.category) >= 3"""


@case("multi_category_complainers", f"SELECT u.username, u.platform, m.types, m.total, m.n_types FROM ({MULTI}) m JOIN {{users}} u ON u.id = m.author_id WHERE u.message_count > 0 ORDER BY m.total DESC, u.id LIMIT 20")
def _(spark, folder, g):
    return qu.multi_category_complainers(g)


def platform_share(category: str) -> str:
    return f"SELECT platform, count(*) AS n, {pct('count(*)', f'''(SELECT count(*) FROM {{facts}} WHERE category = '{category}')''')} AS pct FROM {{facts}} WHERE category = '{category}' GROUP BY platform"


@case("pricing_by_platform", platform_share("pricing_complaints"))
def _(spark, folder, g):
    return qu.pricing_by_platform(g)


@case("integration_by_platform", platform_share("integration_requests"))
def _(spark, folder, g):
    return qu.integration_by_platform(g)


@case("category_platform_pivot", f"""
SELECT category, count(*) FILTER (WHERE platform = 'discord') AS discord, count(*) FILTER (WHERE platform = 'reddit') AS reddit, count(*) AS total,
  {pct("count(*) FILTER (WHERE platform = 'discord')", 'count(*)')} AS discord_pct FROM {{facts}} GROUP BY category""")
def _(spark, folder, g):
    return qu.category_platform_pivot(g)


@case("platform_user_behavior", f"SELECT platform, count(*) AS users, {ratio('sum(message_count)', 'count(*)')} AS avg_messages, max(message_count) AS max_messages FROM {{users}} GROUP BY platform")
def _(spark, folder, g):
    return qu.platform_user_behavior(g)


def both(a: str, b: str) -> str:
    return f"""SELECT f.author_id, count(*) FILTER (WHERE f.category = '{a}') AS n_a, count(*) FILTER (WHERE f.category = '{b}') AS n_b
FROM {{facts}} f WHERE f.category IN ('{a}', '{b}') GROUP BY 1 HAVING count(DISTINCT f.category) = 2"""


def bundle(a: str, b: str) -> str:
    return f"""SELECT u.username, u.platform, sum(x.n_a)::BIGINT AS n_a, sum(x.n_b)::BIGINT AS n_b, u.message_count AS total_messages FROM ({both(a, b)}) x
JOIN {{users}} u ON u.id = x.author_id GROUP BY u.username, u.platform, u.message_count ORDER BY sum(x.n_a) + sum(x.n_b) DESC, u.username, u.platform, u.message_count LIMIT 20"""


@case("wants_integration_and_auth", bundle("integration_requests", "authentication_needs"))
def _(spark, folder, g):
    return qu.wants_integration_and_auth(g)


@case("bugs_and_performance", f"""
WITH t AS ({bundle('bug_reports', 'performance_issues')}),
s AS (SELECT DISTINCT u.username, u.platform, u.message_count AS total_messages, f.content FROM {{facts}} f JOIN {{users}} u ON u.id = f.author_id
  WHERE f.category = 'bug_reports' AND f.author_id IN (SELECT author_id FROM ({both('bug_reports', 'performance_issues')}))),
r AS (SELECT *, row_number() OVER (PARTITION BY username, platform, total_messages ORDER BY content) AS rn FROM s)
SELECT t.*, (SELECT string_agg(r.content, '{SEP}' ORDER BY r.rn) FROM r WHERE r.rn <= 2 AND r.username = t.username AND r.platform = t.platform AND r.total_messages = t.total_messages) AS samples FROM t""")
def _(spark, folder, g):
    return qu.bugs_and_performance(g)


@case("feature_wishlist_champions", f"SELECT username, platform, n, samples FROM ({by_user('feature_requests', 15, 5, 'n')})")
def _(spark, folder, g):
    return qu.feature_wishlist_champions(g)


@case("customization_seekers", """
SELECT u.username, u.platform, count(*) OVER (PARTITION BY u.username, u.platform) AS n, f.timestamp, f.id, f.content
FROM {facts} f JOIN {users} u ON u.id = f.author_id WHERE f.category = 'customization_requests'""")
def _(spark, folder, g):
    return qu.customization_seekers(g)


@case("export_integration_requesters", """
WITH t AS (SELECT author_id, count(*) AS n FROM {facts} WHERE category = 'integration_requests' AND author_id IN (SELECT id FROM {users}) GROUP BY 1 ORDER BY n DESC, author_id LIMIT 100)
SELECT u.username, u.platform, u.message_count AS total_messages, t.n, f.timestamp, f.id, f.content FROM {facts} f JOIN t ON t.author_id = f.author_id JOIN {users} u ON u.id = f.author_id
WHERE f.category = 'integration_requests'""")
def _(spark, folder, g):
    return qu.export_integration_requesters(g)


@case("thread_depth_by_topic", """
WITH RECURSIVE path(id, depth) AS (SELECT parent_id, 1 FROM {reps} UNION ALL SELECT r.parent_id, p.depth + 1 FROM path p JOIN {reps} r ON r.child_id = p.id WHERE p.depth < 5)
SELECT l.category AS topic, count(DISTINCT p.id) AS thread_starters, CAST(max(p.depth) AS BIGINT) AS longest, sum(p.depth)::DOUBLE / count(*) AS avg_depth
FROM path p JOIN {lab} l ON l.message_id = p.id GROUP BY 1""")
def _(spark, folder, g):
    return qu.thread_depth_by_topic(g)


@case("escalations_to_pricing", f"""
WITH pr AS (SELECT message_id FROM {{lab}} WHERE category = 'pricing_complaints'),
e AS (SELECT r.child_id, l.category AS started_as FROM {{reps}} r JOIN {{lab}} l ON l.message_id = r.parent_id WHERE r.child_id IN (SELECT message_id FROM pr) AND r.parent_id NOT IN (SELECT message_id FROM pr)),
s AS (SELECT e.started_as, m.content, row_number() OVER (PARTITION BY e.started_as ORDER BY m.timestamp DESC, m.id) AS rn FROM e JOIN {{messages}} m ON m.id = e.child_id)
SELECT started_as, count(*) AS n, string_agg(content, '{SEP}' ORDER BY rn) FILTER (WHERE rn <= 3) AS samples FROM s GROUP BY 1""")
def _(spark, folder, g):
    return qu.escalations_to_pricing(g)


@case("influential_thread_starters", """
SELECT f.category, u.username AS author, f.content AS message, r.replies, f.platform FROM (SELECT parent_id, count(*) AS replies FROM {reps} GROUP BY 1) r
JOIN {facts} f ON f.id = r.parent_id JOIN {users} u ON u.id = f.author_id ORDER BY r.replies DESC, f.id, f.category LIMIT 20""")
def _(spark, folder, g):
    return qu.influential_thread_starters(g)


@case("power_users_by_category", f"""
WITH c AS (SELECT f.category, u.id, u.username, u.platform, count(*) AS n FROM {{facts}} f JOIN {{users}} u ON u.id = f.author_id WHERE f.category IN {in_(fv.OPPORTUNITY_CATEGORIES)} GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, id) AS rn FROM c)
SELECT category, string_agg(username || '/' || platform || '/' || CAST(n AS STRING), '{SEP}' ORDER BY rn) AS top_users FROM r WHERE rn <= 5 GROUP BY 1""")
def _(spark, folder, g):
    return qu.power_users_by_category(g)


@case("user_segments", f"""
SELECT CASE WHEN message_count >= 50 THEN 'hardcore' WHEN message_count >= 20 THEN 'power_user' WHEN message_count >= 5 THEN 'regular' ELSE 'casual' END AS user_type,
  count(*) AS users, {ratio('sum(message_count)', 'count(*)')} AS avg_messages, {pct('count(*)', '(SELECT count(*) FROM {users})')} AS pct FROM {{users}} GROUP BY 1""")
def _(spark, folder, g):
    return qu.user_segments(g)


@case("questions_then_complaints", f"""
SELECT u.username, u.platform, b.category AS complaint_type, count(DISTINCT b.id) AS n, u.message_count AS total_messages
FROM {{facts}} b JOIN (SELECT author_id, min(timestamp) AS t FROM {{facts}} WHERE category = 'questions' GROUP BY 1) a ON a.author_id = b.author_id AND b.timestamp > a.t
JOIN {{users}} u ON u.id = b.author_id WHERE b.category IN {in_(fv.ESCALATION_CATEGORIES)} GROUP BY u.id, u.username, u.platform, b.category, u.message_count ORDER BY n DESC, u.id, b.category LIMIT 20""")
def _(spark, folder, g):
    return qu.questions_then_complaints(g)


def by_person(category: str, people: str, keys: str, k: int) -> str:
    on = " AND ".join(f"s.{x.strip()} = t.{x.strip()}" for x in keys.split(","))
    return f"""
WITH p AS ({people}), f AS (SELECT f.id, f.timestamp, f.content, p.* EXCLUDE (uid) FROM {{facts}} f JOIN p ON p.uid = f.author_id WHERE f.category = '{category}'),
t AS (SELECT {keys}, count(*) AS n FROM f GROUP BY {keys} ORDER BY n DESC, {keys} LIMIT {k}),
s AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {NEWEST}) AS rn FROM f)
SELECT t.*, (SELECT string_agg(s.content, '{SEP}' ORDER BY s.rn) FROM s WHERE s.rn <= 3 AND {on}) AS samples FROM t"""


@case("reddit_pricing_complainers", by_person("pricing_complaints", "SELECT id AS uid, username FROM {users} WHERE platform = 'reddit'", "username", 15))
def _(spark, folder, g):
    return qu.reddit_pricing_complainers(g)


@case("discord_feature_power_users", by_person("feature_requests", "SELECT id AS uid, username, message_count AS total_messages FROM {users} WHERE platform = 'discord' AND message_count > 20", "username, total_messages", 15))
def _(spark, folder, g):
    return qu.discord_feature_power_users(g)


@case("auth_and_integration_users", f"""
SELECT u.username, u.platform, x.n, u.message_count AS total_messages FROM (SELECT author_id, count(*) AS n FROM {{facts}} WHERE category IN {in_(fv.SECURITY_CATEGORIES)} GROUP BY 1 HAVING count(DISTINCT category) = 2) x
JOIN {{users}} u ON u.id = x.author_id""")
def _(spark, folder, g):
    return qu.auth_and_integration_users(g)


@case("early_adopters_to_complainers", f"""
SELECT u.username, u.platform, x.n, u.message_count AS total_messages, {TIME('u.first_seen')} AS joined, {TIME('x.t')} AS first_complaint
FROM (SELECT author_id, min(timestamp) AS t, count(*) AS n FROM {{facts}} WHERE category IN {in_(fv.ESCALATION_CATEGORIES)} GROUP BY 1) x JOIN {{users}} u ON u.id = x.author_id
WHERE u.first_seen < x.t - 5 * 86400 ORDER BY x.n DESC, u.id LIMIT 20""")
def _(spark, folder, g):
    return qu.early_adopters_to_complainers(g, gap_days=5)


@case("recent_in_category", f"SELECT content AS message, platform, {TIME('timestamp')} AS posted_at FROM {{facts}} WHERE category = 'integration_requests' ORDER BY {NEWEST} LIMIT 50")
def _(spark, folder, g):
    return qu.recent_in_category(g)


@case("keyword_search", f"SELECT content AS message, category, platform, {TIME('timestamp')} AS posted_at FROM {{facts}} WHERE contains(lower(content), 'stripe') ORDER BY {NEWEST}, category LIMIT 30")
def _(spark, folder, g):
    return qu.keyword_search(g)


@case("price_mentions", rf"""
SELECT content AS message, platform, {TIME('timestamp')} AS posted_at FROM {{facts}} WHERE category = 'pricing_complaints'
AND (regexp_matches(content, '\A.*\$[0-9]+.*\z') OR regexp_matches(content, '\A.*[0-9]+/mo.*\z')) ORDER BY {NEWEST} LIMIT 30""")
def _(spark, folder, g):
    return qu.price_mentions(g)


@case("top5_complainer_subgraph", """
SELECT author_id AS user_id, id AS message_id, category FROM {facts} WHERE category = 'pricing_complaints' AND author_id IN
(SELECT author_id FROM {facts} WHERE category = 'pricing_complaints' AND author_id IN (SELECT id FROM {users}) GROUP BY 1 ORDER BY count(*) DESC, author_id LIMIT 5)""")
def _(spark, folder, g):
    return qu.top5_complainer_subgraph(g)


@case("integration_requester_network", f"""
SELECT author_id AS user_id, id AS message_id, category FROM {{facts}} WHERE category = 'integration_requests' AND author_id IN
(SELECT author_id FROM {{facts}} WHERE category = 'integration_requests' AND author_id IN (SELECT id FROM {{users}}) GROUP BY 1 HAVING count(*) >= 3) ORDER BY {NEWEST} LIMIT 100""")
def _(spark, folder, g):
    return qu.integration_requester_network(g)


@case("multi_complainer_subgraph", f"""
WITH m AS (SELECT author_id, types FROM ({MULTI}) WHERE author_id IN (SELECT id FROM {{users}}) ORDER BY author_id LIMIT 50),
s AS (SELECT author_id, id, row_number() OVER (PARTITION BY author_id ORDER BY {NEWEST}, category) AS rn FROM {{facts}} WHERE category IN {in_(fv.COMPLAINT_CATEGORIES)})
SELECT m.author_id AS user_id, m.types AS categories, string_agg(s.id, '{SEP}' ORDER BY s.rn) AS messages FROM m JOIN s ON s.author_id = m.author_id AND s.rn <= 10 GROUP BY 1, 2""")
def _(spark, folder, g):
    return qu.multi_complainer_subgraph(g)


@case("category_summary", f"""
SELECT t.name AS category, t.description, count(DISTINCT f.id) AS messages, count(DISTINCT u.id) AS users, {pct2('count(DISTINCT f.id)', '(SELECT count(*) FROM {nodes})')} AS pct
FROM {{taxonomy}} t LEFT JOIN {{facts}} f ON f.category = t.name LEFT JOIN {{users}} u ON u.id = f.author_id GROUP BY 1, 2""")
def _(spark, folder, g):
    return qu.category_summary(g)


@case("reddit_super_users", f"""
SELECT u.username, count(*) AS n, u.message_count AS total_messages, array_to_string(list_sort(list(DISTINCT f.category)), '{SEP}') AS categories FROM {{facts}} f JOIN {{users}} u ON u.id = f.author_id
WHERE u.platform = 'reddit' AND f.category IN {in_(fv.WISH_CATEGORIES)} GROUP BY u.username, u.message_count ORDER BY n DESC, u.username, u.message_count LIMIT 20""")
def _(spark, folder, g):
    return qu.reddit_super_users(g)


@case("discord_pain_points", f"""
SELECT category, count(*) AS n, {pct2('count(*)', "(SELECT count(*) FROM {nodes} WHERE platform = 'discord')")} AS pct FROM {{facts}} WHERE platform = 'discord' AND category IN {in_(fv.PAIN_CATEGORIES)} GROUP BY 1""")
def _(spark, folder, g):
    return qu.discord_pain_points(g)


@case("opportunity_heatmap", f"""
WITH x AS (SELECT f.category, f.platform, f.id, u.id AS uid, u.username FROM {{facts}} f JOIN {{users}} u ON u.id = f.author_id WHERE f.category IN {in_(fv.OPPORTUNITY_CATEGORIES)})
SELECT category, platform, count(DISTINCT id) AS messages, count(DISTINCT uid) AS users, {ratio('count(DISTINCT id)', 'count(DISTINCT uid)')} AS avg_per_user,
  array_to_string(list_sort(list(DISTINCT username))[1:10], '{SEP}') AS sample_users FROM x GROUP BY 1, 2""")
def _(spark, folder, g):
    return qu.opportunity_heatmap(g)


# --- 2H exploration ------------------------------------------------------------------------------


@case("categories_by_size", "SELECT t.name, t.description, count(m.category) AS message_count FROM {taxonomy} t LEFT JOIN {message_taxonomy} m ON m.category = t.name GROUP BY 1, 2")
def _(spark, folder, g):
    return ex.categories_by_size(g)


def edges(where: str, limit: int | None, user: bool) -> str:
    known = " AND author_id IN (SELECT id FROM {users})" if user else ""
    return (
        "SELECT category, id AS message_id" + (", author_id AS user_id" if user else "") + f" FROM {{facts}} WHERE {where}{known}"
        + (f" ORDER BY {NEWEST}, category LIMIT {limit}" if limit else "")
    )


@case("category_message_edges", edges("true", 200, False))
def _(spark, folder, g):
    return ex.category_message_edges(g)


@case("category_neighbourhood", edges("category = 'feature_requests'", 100, True))
def _(spark, folder, g):
    return ex.category_neighbourhood(g, "feature_requests", 100)


@case("actionable_sample", edges(f"category IN {in_(fv.SAMPLED_CATEGORIES)}", 150, False))
def _(spark, folder, g):
    return ex.actionable_sample(g)


@case("power_users", "SELECT id, platform, username, message_count FROM {users} WHERE message_count > 20 ORDER BY message_count DESC, id LIMIT 50")
def _(spark, folder, g):
    return ex.power_users(g)


@case("power_user_messages", f"SELECT author_id AS user_id, id AS message_id FROM {{nodes}} WHERE author_id IN (SELECT id FROM {{users}} WHERE message_count > 30) ORDER BY {NEWEST} LIMIT 100")
def _(spark, folder, g):
    return ex.power_user_messages(g)


@case("most_active_users", "SELECT platform, username, message_count AS messages FROM {users} ORDER BY message_count DESC, id LIMIT 20")
def _(spark, folder, g):
    return ex.most_active_users(g)


@case("messages_per_platform", "SELECT platform, count(*) AS n FROM {nodes} GROUP BY 1")
def _(spark, folder, g):
    return ex.messages_per_platform(g)


@case("platform_samples", f"SELECT platform, content, source FROM {{nodes}} ORDER BY {NEWEST} LIMIT 20")
def _(spark, folder, g):
    return ex.platform_samples(g)


@case("reply_pairs", "SELECT child_id, parent_id FROM {reps} ORDER BY child_id, parent_id LIMIT 50")
def _(spark, folder, g):
    return ex.reply_pairs(g)


@case("deep_threads", f"""
WITH RECURSIVE path(p, last, depth) AS (SELECT [child_id, parent_id], parent_id, 1 FROM {{reps}}
  UNION ALL SELECT list_append(path.p, r.parent_id), r.parent_id, path.depth + 1 FROM path JOIN {{reps}} r ON r.child_id = path.last WHERE path.depth < 3)
SELECT array_to_string(p, '{SEP}') AS path FROM path ORDER BY p LIMIT 30""")
def _(spark, folder, g):
    return ex.deep_threads(g)


@case("vocal_integration_users", "SELECT u.username, u.platform, count(*) AS n FROM {facts} f JOIN {users} u ON u.id = f.author_id WHERE f.category = 'integration_requests' GROUP BY u.id, u.username, u.platform HAVING count(*) > 3")
def _(spark, folder, g):
    return ex.vocal_integration_users(g)


@case("feature_and_integration_pairs", """
SELECT a.author_id AS user_id, a.id AS m1, b.id AS m2 FROM {facts} a JOIN {facts} b ON a.author_id = b.author_id AND a.category = 'feature_requests' AND b.category = 'integration_requests'
WHERE a.author_id IN (SELECT id FROM {users}) ORDER BY 1, 2, 3 LIMIT 50""")
def _(spark, folder, g):
    return ex.feature_and_integration_pairs(g)


@case("auth_and_integration_counts", f"SELECT u.username, sum(x.n_a)::BIGINT AS n_a, sum(x.n_b)::BIGINT AS n_b FROM ({both('authentication_needs', 'integration_requests')}) x JOIN {{users}} u ON u.id = x.author_id GROUP BY 1")
def _(spark, folder, g):
    return ex.auth_and_integration_counts(g)


@case("category_distribution", f"SELECT t.name AS category, t.description, count(f.id) AS n, {pct('count(f.id)', '(SELECT count(*) FROM {nodes})')} AS pct FROM {{taxonomy}} t LEFT JOIN {{facts}} f ON f.category = t.name GROUP BY 1, 2")
def _(spark, folder, g):
    return ex.category_distribution(g)


@case("platform_by_category", "SELECT category, platform, count(*) AS n FROM {facts} GROUP BY 1, 2")
def _(spark, folder, g):
    return ex.platform_by_category(g)


@case("daily_timeline", "SELECT CAST(CAST(make_timestamp(timestamp * 1000000) AS DATE) AS STRING) AS date, count(*) AS n FROM {nodes} GROUP BY 1")
def _(spark, folder, g):
    return ex.daily_timeline(g)


@case("activity_histogram", "SELECT message_count, count(*) AS users FROM {users} GROUP BY 1")
def _(spark, folder, g):
    return ex.activity_histogram(g)


@case("graph_sample", edges("true", 200, True))
def _(spark, folder, g):
    return ex.graph_sample(g)


@case("actionable_edges", edges("category NOT IN ('spam_noise', 'questions')", 200, False))
def _(spark, folder, g):
    return ex.actionable_edges(g)


@case("small_category_subgraph", edges(f"category IN {in_(fv.SMALL_CATEGORIES)}", None, True))
def _(spark, folder, g):
    return ex.small_category_subgraph(g)


# --- 2I reports ----------------------------------------------------------------------------------


@case("report_platform_distribution", f"WITH {INTEGRATION} SELECT platform, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM im)')} AS pct FROM im GROUP BY 1")
def _(spark, folder, g):
    return rp.report_platform_distribution(rp.integration_messages(g))


@case("report_top_keywords", f"WITH {INTEGRATION} SELECT keyword, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM im)')} AS pct FROM (SELECT unnest(keywords) AS keyword FROM im) GROUP BY 1 ORDER BY n DESC, keyword LIMIT 30")
def _(spark, folder, g):
    return rp.report_top_keywords(rp.integration_messages(g))


@case("report_auto_category_counts", f"WITH {INTEGRATION} SELECT auto_category, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM im)')} AS pct FROM (SELECT unnest(auto_categories) AS auto_category FROM im) GROUP BY 1 ORDER BY n DESC, auto_category LIMIT 10")
def _(spark, folder, g):
    return rp.report_auto_category_counts(rp.integration_messages(g))


@case("report_messages_per_category", f"""
WITH {INTEGRATION}, e AS (SELECT *, unnest(auto_categories) AS auto_category FROM im),
r AS (SELECT *, row_number() OVER (PARTITION BY auto_category ORDER BY {NEWEST}) AS rank, count(*) OVER (PARTITION BY auto_category) AS total FROM e)
SELECT auto_category, rank, content AS message, platform, username, total, greatest(total - 50, 0) AS more FROM r WHERE rank <= 50""")
def _(spark, folder, g):
    return rp.report_messages_per_category(rp.integration_messages(g), g.messages)


@case("report_top_requesters", f"WITH {INTEGRATION} SELECT username, count(*) AS n FROM im GROUP BY 1 ORDER BY n DESC, username LIMIT 10")
def _(spark, folder, g):
    return rp.report_top_requesters(rp.integration_messages(g))


@case("report_insights", f"""WITH {INTEGRATION}
SELECT 'migration_export' AS metric, count(*) FILTER (WHERE list_contains(auto_categories, 'migration_export')) AS n FROM im
UNION ALL SELECT 'supabase', count(*) FILTER (WHERE list_contains(keywords, 'supabase')) FROM im UNION ALL SELECT 'stripe', count(*) FILTER (WHERE list_contains(keywords, 'stripe')) FROM im
UNION ALL SELECT 'discord', count(*) FILTER (WHERE platform = 'discord') FROM im UNION ALL SELECT 'reddit', count(*) FILTER (WHERE platform = 'reddit') FROM im""")
def _(spark, folder, g):
    return rp.report_insights(rp.integration_messages(g))


@case("report_category_distribution", f"SELECT category, count(*) AS n, {pct('count(*)', f'(SELECT count(*) FROM {{author_rows}} WHERE category IN {in_(fv.REPORT_CATEGORIES)})')} AS pct FROM {{author_rows}} WHERE category IN {in_(fv.REPORT_CATEGORIES)} GROUP BY 1")
def _(spark, folder, g):
    return rp.report_category_distribution(g)


@case("report_top_themes", f"""
WITH {TOP_WORDS}, ts AS (SELECT theme, count(*) AS messages, count(DISTINCT username) AS users, array_to_string(list_sort(list(DISTINCT category)), '{SEP}') AS categories FROM tm GROUP BY theme ORDER BY messages DESC, theme LIMIT 15)
SELECT ts.*, (SELECT string_agg(tr.keyword, '{SEP}' ORDER BY tr.rank) FROM tr WHERE tr.theme = ts.theme AND tr.rank <= 10) AS keywords FROM ts""")
def _(spark, folder, g):
    return rp.report_top_themes(rp.keyword_messages(g))


@case("report_cross_patterns", f"WITH {CROSS} SELECT * FROM cross_kw ORDER BY total_mentions DESC, keyword LIMIT 20")
def _(spark, folder, g):
    return rp.report_cross_patterns(en.cross_category_keywords(rp.keyword_messages(g)))


@case("report_theme_samples", f"""
WITH {THEMES}, r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY {NEWEST}, category) AS rank, count(*) OVER (PARTITION BY theme) AS total FROM tm)
SELECT theme, rank, category, platform, username, array_to_string(tools, '{SEP}') AS tools, substring(content, 1, 500) AS message, total FROM r WHERE rank <= 20 AND total >= 10""")
def _(spark, folder, g):
    return rp.report_theme_samples(rp.keyword_messages(g), g.messages)


@case("report_migration_mentions", f"WITH {CROSS} SELECT coalesce(sum(total_mentions), 0)::BIGINT AS n FROM cross_kw WHERE keyword IN ('migrate', 'export')")
def _(spark, folder, g):
    return rp.report_migration_mentions(en.cross_category_keywords(rp.keyword_messages(g)))


# --- 2J streams ----------------------------------------------------------------------------------


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream of messages."""
    schema = base_table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).parquet(os.path.join(folder, "events*.parquet"))
    return events.select(
        F.concat(F.lit("m_"), "event_id").alias("id"), F.concat(F.lit("u_"), "user_id").alias("author_id"),
        F.concat(F.lit("please "), "event_type", F.lit(" it costs $"), F.floor("value")).alias("content"),
        F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).alias("timestamp"),
        F.col("event_type").alias("category"),
    )


def run_stream(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there, into files, and read them back."""
    out = work_folder(spark)
    target = os.path.join(out, "rows")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("append").parquet(target)

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", os.path.join(out, "checkpoint"))
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


@case("stream_ingest_dedup", "SELECT 'm_' || CAST(event_id AS STRING) AS id, 'u_' || CAST(user_id AS STRING) AS author_id FROM {events}")
def _(spark, folder, g):
    out = work_folder(spark)
    landing, target = os.path.join(out, "landing"), os.path.join(out, "messages")
    base_table(spark, folder, "events").select("event_id", "user_id", F.col("ts").cast("string").alias("ts")).write.json(landing)

    def normal(rows: DataFrame) -> DataFrame:
        made = rows.select(
            F.concat(F.lit("m_"), "event_id").alias("id"), F.concat(F.lit("u_"), "user_id").alias("author_id"), F.lit("x").alias("content"),
            F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")).alias("timestamp"))
        return made.withColumn("id", F.explode(F.array("id", "id")))

    once = st.stream_ingest_dedup(spark, landing, "event_id long, user_id long, ts string", normal)
    for attempt in ("first", "replay"):
        # The second run has a fresh checkpoint: it replays every row and must add none.
        (once.writeStream.option("checkpointLocation", os.path.join(out, attempt)).trigger(availableNow=True)
         .foreachBatch(st.append_new(target)).start().awaitTermination())
    return spark.read.schema(once.schema).parquet(target).select("id", "author_id")


@case("stream_user_activity", """
SELECT 'u_' || CAST(user_id AS STRING) AS author_id, count(*) AS message_count, min({epoch}) AS first_seen, max({epoch}) AS last_seen FROM {events} e GROUP BY 1""")
def _(spark, folder, g):
    out = work_folder(spark)
    stream, target = st.stream_user_activity(event_stream(spark, folder)), os.path.join(out, "updates")
    (stream.writeStream.outputMode("update").option("checkpointLocation", os.path.join(out, "checkpoint")).trigger(availableNow=True)
     .foreachBatch(st.merge_updates(target)).start().awaitTermination())
    return st.latest_updates(spark, target, "author_id string, message_count long, first_seen long, last_seen long", "author_id")


@case("activity_increments", """
SELECT author_id AS id, platform, author_id AS username, count(*) AS message_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen
FROM {messages} GROUP BY author_id, platform""")
def _(spark, folder, g):
    """All messages in five batches, one of them played twice, with merges in between."""
    target = os.path.join(work_folder(spark), "activity")
    add = st.add_activity(target, max_deltas=2)
    for epoch in (0, 1, 2, 2, 3, 4):
        add(g.messages.filter(F.pmod(F.xxhash64("id"), F.lit(5)) == epoch), epoch)
    return st.stored_activity(spark, target)


@case("stream_daily_category_counts", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day_start, event_type AS category, count(*) AS n FROM {events} GROUP BY 1, 2
HAVING date_trunc('day', max(ts)) + INTERVAL 1 DAY <= (SELECT date_trunc('second', max(ts)) FROM {events}) - INTERVAL 1 DAY""")
def _(spark, folder, g):
    rows = run_stream(spark, st.stream_daily_category_counts(event_stream(spark, folder)), "append")
    seconds = F.unix_seconds("day_start")
    return rows.select(utc_timestamp(seconds).alias("day_start"), "category", "n")


@case("stream_classify", f"SELECT 'm_' || CAST(event_id AS STRING) AS message_id, {RULES} AS category FROM (SELECT event_id, lower('please ' || event_type || ' it costs $' || CAST(CAST(floor(value) AS BIGINT) AS STRING)) AS t FROM {{events}})")
def _(spark, folder, g):
    return run_stream(spark, st.stream_classify(event_stream(spark, folder)), "append")


@case("incremental_ingest", """
SELECT 'discord_' || CAST(e.event_id AS STRING) AS id, 'discord_' || CAST(e.user_id AS STRING) AS author_id, {epoch} AS timestamp
FROM {events} e LEFT JOIN {documents} d ON d.doc_id = e.event_id WHERE e.event_type <> 'error' AND (e.value > 50 OR e.event_type <> 'click')
  AND (e.value > 50 OR trim(coalesce(d.text, e.props), ' ' || chr(9) || chr(10) || chr(13)) <> '')""")
def _(spark, folder, g):
    out = work_folder(spark)
    landing, target, checkpoint = (os.path.join(out, name) for name in ("landing", "target", "checkpoint"))
    records = raw_chat(spark, folder)
    for arrival in (records.filter("author.bot OR type = 19"), records):
        # The second arrival repeats records of the first; only new ids are added.
        arrival.write.mode("append").json(landing)
        st.incremental_ingest(
            spark, landing, target, checkpoint, RAW_CHAT, lambda r: raw.normalize_chat(r, "general")
        ).awaitTermination()
    return spark.read.parquet(target).select("id", "author_id", "timestamp")


@case("write_cluster_samples", """
WITH r AS (SELECT c.cluster_id, c.message_id, count(*) OVER (PARTITION BY c.cluster_id) AS size,
  row_number() OVER (PARTITION BY c.cluster_id ORDER BY md5(c.message_id || '42'), c.message_id) AS rank FROM {message_clusters} c WHERE c.cluster_id <> -1)
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, size, string_agg(r.message_id || '/' || m.platform || '/' || m.source || '/' || md5(substring(m.content, 1, 200)), ' | ' ORDER BY r.message_id) AS samples
FROM r JOIN {messages} m ON m.id = r.message_id WHERE rank <= 5 GROUP BY 1, 2""")
def _(spark, folder, g):
    path = os.path.join(work_folder(spark), "samples")
    sinks.write_cluster_samples(cl.cluster_samples(with_noise(g), g.messages), path)
    rows = spark.read.schema("cluster_id bigint, size bigint, samples array<struct<id:string,platform:string,source:string,preview:string>>").json(path)
    return rows.select("cluster_id", "size", F.transform("samples", lambda s: F.concat_ws("/", s["id"], s["platform"], s["source"], F.md5(s["preview"]))).alias("samples"))


CORPUS_SUMS = {
    "messages": "timestamp", "users": "message_count", "message_taxonomy": "created_at", "extracted_entities": "confidence", "embeddings_reference": "id",
    "clustering_runs": "n_samples", "message_clusters": "cluster_id", "taxonomy_runs": "n_messages", "vectors": "timestamp",
}


@case("read_corpus", " UNION ALL ".join(
    f"SELECT '{name}' AS name, count(*) AS n, round(CAST(sum({c}) AS DOUBLE), 6) AS total FROM {{{name}}}" for name, c in CORPUS_SUMS.items()))
def _(spark, folder, g):
    """All nine tables, written and opened again."""
    out = work_folder(spark)
    for name in CORPUS_SUMS:
        getattr(g, name).write.parquet(os.path.join(out, name))
    opened = read_corpus(spark, out)
    parts = [
        getattr(opened, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.round(F.sum(c).cast("double"), 6).alias("total"))
        for name, c in CORPUS_SUMS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@case("write_themes", f"""
WITH {TOP_WORDS}, ts AS (SELECT theme, count(*) AS messages, count(DISTINCT username) AS users, array_to_string(list_sort(list(DISTINCT category)), '{SEP}') AS categories FROM tm GROUP BY theme)
SELECT ts.*, (SELECT string_agg(tr.keyword || '/' || CAST(tr.n AS STRING), '{SEP}' ORDER BY tr.rank) FROM tr WHERE tr.theme = ts.theme AND tr.rank <= 20) AS top_keywords FROM ts""")
def _(spark, folder, g):
    kw = rp.keyword_messages(g)
    path = os.path.join(work_folder(spark), "themes")
    sinks.write_themes(en.opportunity_themes(kw), en.theme_top_keywords(kw), path)
    return spark.read.schema("theme string, messages long, users long, categories array<string>, top_keywords array<struct<keyword:string,n:long>>").json(path)


@case("write_cross_patterns", f"WITH {CROSS} SELECT * FROM cross_kw")
def _(spark, folder, g):
    path = os.path.join(work_folder(spark), "cross")
    sinks.write_cross_patterns(en.cross_category_keywords(rp.keyword_messages(g)), path)
    return spark.read.schema("keyword string, total_mentions long, category_count long, breakdown map<string,long>").json(path)
