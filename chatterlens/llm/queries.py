"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlens.llm import collocations, hard_negatives, license_scan, line_dedup, ngram_join, packing, piece_bpe, quality, token_count, topk, toxicity, url_filter, warc
from chatterlens.llm.base import table

URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What line deduplication leaves of every document, as a digest."""
    made = line_dedup.without_widespread_lines(table(spark, folder, "documents"))
    return made.select("doc_id", "n_lines_removed", F.length("text").cast("long").alias("n_chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op2_threshold_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op4_piece_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return piece_bpe.encode_decode(table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents")).drop("d2", "row_key")


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_token_count(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.count_tokens(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("row_key")


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"), URL_RULES)


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, folder, "documents")).drop("matches")


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, coalesce(source, chr(0)) AS site, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), trimmed AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS norm FROM lines
), common AS (
  SELECT norm, min(doc_id) AS first FROM trimmed WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT site) >= 8
), marked AS (
  SELECT t.doc_id, pos, line, c.norm IS NOT NULL AND t.doc_id <> c.first AS gone FROM trimmed t LEFT JOIN common c USING (norm)
), left_over AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_lines_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines_removed, 0) AS n_lines_removed, length(l.text) AS n_chars_left, md5(l.text) AS text_md5
FROM documents d LEFT JOIN left_over l USING (doc_id)
"""

OP2_SQL = """
WITH vectors AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM vectors q, vectors c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP3_SQL = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), marked AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM marked
"""

OP5_SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM worded
), numbered AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM shingled
), hashed AS (
  SELECT doc_id, n, hash(x) AS h, row_number() OVER (PARTITION BY doc_id ORDER BY hash(x)) AS k FROM numbered
), prefix AS (
  SELECT * FROM hashed WHERE k <= n - ceil(0.8 * n) + 1
), pairs AS (
  SELECT DISTINCT a.doc_id AS i, b.doc_id AS j FROM prefix a JOIN prefix b ON a.h = b.h AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), shared AS (
  SELECT i, j, count(*) AS c FROM pairs JOIN hashed a ON a.doc_id = i JOIN hashed b ON b.doc_id = j AND b.h = a.h GROUP BY i, j
), links AS (
  SELECT i, j FROM shared JOIN shingled a ON a.doc_id = i JOIN shingled b ON b.doc_id = j
  WHERE 100 * c >= 80 * (len(a.s) + len(b.s) - c)
), both_ways AS (
  SELECT i, j FROM links UNION SELECT j, i FROM links
), reach(i, j) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.i, b.j FROM reach r JOIN both_ways b ON b.i = r.j
)
SELECT doc_id, len(s) AS n_shingles, component_id
FROM shingled JOIN (SELECT i AS doc_id, min(j) AS component_id FROM reach GROUP BY i) USING (doc_id)
"""

OP10_SQL = """
WITH rests AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests
), parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts
), ruled AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

OP11_SQL = """
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts
), worded AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS m, unnest(w) AS phrase FROM worded
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM worded
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM worded
), counted AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM counted WHERE m = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE m > 1 AND f >= 10
), cuts AS (
  SELECT lang, phrase, a, 1 AS k, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM candidates
  UNION ALL SELECT lang, phrase, a, 2, array_to_string(w[1:2], ' '), w[3] FROM candidates WHERE m = 3
), sided AS (
  SELECT c.lang, c.phrase, c.a, c.k, p.f AS l, q.f AS r, (1000000::HUGEINT * c.a * c.a) // (p.f::HUGEINT * q.f) AS score FROM cuts c
  JOIN counted p ON p.lang = c.lang AND p.phrase = c.x
  JOIN counted q ON q.lang = c.lang AND q.phrase = c.y
), best AS (
  SELECT * FROM sided QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer FROM candidates WHERE m = 3
), covered AS (
  SELECT lang, phrase, max(longer) AS longer FROM inner_parts GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN covered c USING (lang, phrase) WHERE c.longer IS NULL OR 100 * c.longer < 50 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

OP12_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a, vectors b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike
  AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
QUALIFY rank <= 10
"""

def _license_rows(texts: list[tuple[str, str]], kind: str) -> str:
    """VALUES of (label, number, place, word, length) for the given (label, text)."""
    rows = []
    for number, (label, text) in enumerate(texts):
        words = [w.decode() for w in license_scan.words_of(text)]
        rows += [f"('{label}', {number}, {i}, '{w}', {len(words)})" for i, w in enumerate(words)]
    return f"{kind}(label, number, place, word, length) AS (VALUES {', '.join(rows)})"


OP13_SQL = f"""
WITH {_license_rows([(label, phrase) for phrase, label in license_scan.PHRASES.items()], "phrases")},
{_license_rows([(label, t) for label, texts in license_scan.TEMPLATES.items() for t in texts], "templates")},
texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM texts
), stands AS (
  SELECT w.doc_id, p.label, p.number, w.pos - p.place AS start FROM words w JOIN phrases p USING (word)
  GROUP BY ALL HAVING count(*) = any_value(p.length)
), base AS (
  SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labels FROM stands GROUP BY doc_id
), hits AS (
  SELECT doc_id, pos, label, number, word, length FROM words JOIN (SELECT DISTINCT label, number, word, length FROM templates) USING (word)
), blocks AS (
  SELECT a.doc_id, a.label, a.number, a.pos, count(DISTINCT b.word) AS shared FROM hits a
  JOIN hits b ON b.doc_id = a.doc_id AND b.number = a.number AND b.pos >= a.pos AND b.pos < a.pos + a.length GROUP BY ALL
), sizes AS (
  SELECT number, count(DISTINCT word) AS size FROM templates GROUP BY number
), found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(CAST(shared AS DOUBLE) / size) AS score FROM blocks JOIN sizes USING (number)
  WHERE 100 * shared >= 80 * size GROUP BY doc_id
)
SELECT t.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
       CASE WHEN b.labels IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(f.score, 0.0::DOUBLE) END AS score
FROM texts t LEFT JOIN base b USING (doc_id) LEFT JOIN found f USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_threshold_topk, op3_warc, op4_piece_bpe, op5_ngram_join, op6_quality, op7_packing,
        op8_token_count, op9_toxicity, op10_url_filter, op11_collocations, op12_hard_negatives, op13_license_scan,
    )
}
SQL: dict[str, str] = {
    "op1_line_dedup": OP1_SQL, "op2_threshold_topk": OP2_SQL, "op3_warc": OP3_SQL, "op5_ngram_join": OP5_SQL, "op10_url_filter": OP10_SQL,
    "op11_collocations": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_license_scan": OP13_SQL,
}
