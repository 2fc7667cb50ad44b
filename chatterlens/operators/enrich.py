"""Text enrichment: eligibility, embeddings, classification, keywords and themes."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatterlens.functions import fixed_values as fv
from chatterlens.functions.columns import explode_once, first_per, name_bit, names_in_bits, strip, word_array
from chatterlens.functions.matching import with_words
from chatterlens.operators.tables import embedding_refs
from chatterlens.operators.vectors import add_vectors
from chatterlens.session import written_once

# What Python hands back to Spark at once: so many rows, or so many numbers of vectors.
FRAME_ROWS = 10_000
FRAME_VALUES = 1 << 19


def embedding_eligible(messages: DataFrame, min_length: int = 20) -> DataFrame:
    """Messages worth embedding: long enough, by people, and not system or removed texts."""
    text = strip("content")
    author = F.get_json_object("metadata", "$.author")
    chat_bot = F.coalesce(F.get_json_object("metadata", "$.author.bot") == "true", F.lit(False))
    chat_type = F.coalesce(F.get_json_object("metadata", "$.type"), F.lit("0"))
    name = F.lower(F.coalesce(author, F.lit("")))
    chat_ok = ~chat_bot & (chat_type == "0")
    forum_ok = ~F.contains(name, F.lit("bot")) & (name != "automoderator") & ~F.lower(text).isin(fv.REMOVED_TEXTS)
    by_platform = F.when(F.col("platform") == "discord", chat_ok).when(F.col("platform") == "reddit", forum_ok).otherwise(True)
    return messages.filter((F.length(text) >= min_length) & by_platform)


def embedding_cost_estimate(messages: DataFrame, usd_per_million: float = 0.02) -> DataFrame:
    """Texts, estimated tokens (four characters each, on the average text) and price."""
    sums = messages.agg(F.count("*").alias("text_count"), F.sum(F.length("content")).alias("chars"))
    per_text = F.floor(F.col("chars") / F.col("text_count") / 4)
    tokens = F.when(F.col("text_count") > 0, F.col("text_count") * per_text).otherwise(0)
    return sums.select("text_count", tokens.alias("tokens")).select(
        "text_count", "tokens", F.round(F.col("tokens") / 1_000_000 * usd_per_million, 4).alias("usd")
    )


def _hashed(texts: DataFrame, dims: int) -> DataFrame:
    """``content`` as a unit vector of hashed word counts in ``embedding``; a text without words has a zero vector."""
    words = RegexTokenizer(inputCol="__text", outputCol="__words", pattern=r"\s+", toLowercase=True)
    counts = HashingTF(inputCol="__words", outputCol="__counts", numFeatures=dims)
    unit = Normalizer(inputCol="__counts", outputCol="__unit", p=2.0)
    frame = texts.withColumn("__text", F.coalesce("content", F.lit("")))
    for step in (words, counts, unit):
        frame = step.transform(frame)
    return frame.withColumn("embedding", vector_to_array("__unit", "float32")).drop("__text", "__words", "__counts", "__unit")


def embed_hashed(messages: DataFrame, dims: int = 256) -> DataFrame:
    """The built-in embedding, an offline stand-in for a service: hashed word counts of unit length, made in the JVM."""
    return _hashed(messages.select(F.col("id").alias("message_id"), "content"), dims).select("message_id", "embedding")


def embed_texts(spark: SparkSession, texts: Sequence[str], dims: int = 256) -> list[list[float]]:
    """The built-in embedding of a few texts, such as search queries."""
    frame = spark.createDataFrame(list(enumerate(texts)), "place int, content string")
    return [list(r["embedding"]) for r in _hashed(frame, dims).orderBy("place").collect()]


def _batches(frame: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    for start in range(0, len(frame), size):
        yield frame.iloc[start:start + size]


def _embedded(frames: Iterator[pd.DataFrame], provider: Callable[[list[str]], list[list[float]]], batch_size: int, retries: int,
              wait_seconds: float) -> Iterator[pd.DataFrame]:
    """The answers to batches of texts. What a frame costs is the same for one row and for many, so small batches share one."""
    ids, made, states, values = [], [], [], 0

    def frame() -> pd.DataFrame:
        return pd.DataFrame({"message_id": ids, "embedding": made, "status": states})

    for rows in frames:
        keys, texts = rows["id"].tolist(), rows["content"].tolist()
        for start in range(0, len(keys), batch_size):
            part = texts[start:start + batch_size]
            vectors, status = [None] * len(part), "failed"
            for attempt in range(retries):
                try:
                    vectors, status = provider(part), "ok"
                    break
                except Exception:
                    time.sleep(wait_seconds * 2**attempt)
            vectors = [None] * len(part) if vectors is None else list(vectors)
            if len(vectors) != len(part):
                raise ValueError(f"the provider gave {len(vectors)} vectors for {len(part)} texts")
            ids += keys[start:start + batch_size]
            made += vectors
            states += [status] * len(part)
            values += sum(0 if v is None else len(v) for v in vectors)
            if len(ids) >= FRAME_ROWS or values >= FRAME_VALUES:
                yield frame()
                ids, made, states, values = [], [], [], 0
    if ids:
        yield frame()


def embed_messages(messages: DataFrame, provider: Callable[[list[str]], list[list[float]]], batch_size: int = 100,
                   retries: int = 3, wait_seconds: float = 0.0) -> DataFrame:
    """Vectors of the texts through a provider called once per batch.

    A batch that keeps failing gives rows with a null vector and status 'failed';
    the job goes on. Spark's partitions bound how many calls run at once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _embedded(frames, provider, batch_size, retries, wait_seconds)

    return messages.select("id", "content").mapInPandas(run, "message_id string, embedding array<float>, status string")


def embed_and_store(messages: DataFrame, vectors: DataFrame, refs: DataFrame, provider: Callable[[list[str]], list[list[float]]],
                    dims: int, model: str, now: int, batch_size: int = 100, retries: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Embed what has no reference yet: (all vectors, all references, (message_id) of the messages that failed).

    The provider's answers are checkpointed, so that no message is sent twice.
    """
    waiting = messages.join(refs.select(F.col("message_id").alias("id")), "id", "left_anti")
    made = written_once(embed_messages(waiting, provider, batch_size, retries))
    good = made.filter("status = 'ok'").select("message_id", "embedding")
    meta = vector_metadata(waiting)
    stored = add_vectors(vectors, good.join(meta, "message_id"), dims)
    added = good.select("message_id", F.concat(F.lit("vec_"), "message_id").alias("chromadb_id"), F.lit(now).cast("bigint").alias("created_at"))
    return stored, embedding_refs(refs, added, model), made.filter("status <> 'ok'").select("message_id")


def vector_metadata(messages: DataFrame) -> DataFrame:
    """The flat columns stored beside a vector, with a preview of 100 characters."""
    return messages.select(
        F.col("id").alias("message_id"), "platform", "source", "timestamp", "author_id",
        F.substring("content", 1, 100).alias("content_preview"),
    )


def payload_line(max_chars: int = 500) -> Column:
    """One message as a line of a classification request."""
    text = F.replace(F.replace(F.substring("content", 1, max_chars), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit('"'), "id", F.lit('": "'), text, F.lit('"'))


def classification_payload(messages: DataFrame, batch_size: int = 100, max_chars: int = 500,
                           bucket_rows: int = 5000) -> DataFrame:
    """Request payloads of at most ``batch_size`` messages.

    Messages are numbered inside hash buckets of about ``bucket_rows`` ids, as many
    buckets as the message count asks for, so no task numbers all of them.
    """
    buckets = messages.agg(F.greatest(F.ceil(F.count("*") / bucket_rows), F.lit(1))).scalar()
    bucket = F.pmod(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint"), buckets)
    numbered = (
        messages.select("id", payload_line(max_chars).alias("line"), bucket.alias("bucket"))
        .withColumn("row", F.row_number().over(Window.partitionBy("bucket").orderBy("id")))
    )
    batch = F.concat_ws("-", "bucket", F.floor((F.col("row") - 1) / batch_size)).alias("batch_id")
    lines = F.array_sort(F.collect_list(F.struct("id", "line")))
    return numbered.groupBy(batch).agg(
        F.count("*").alias("n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("payload")
    )


def classify_messages(messages: DataFrame, provider: Callable[[dict[str, str]], Mapping[str, str]] | None = None,
                      batch_size: int = 100, max_chars: int = 500) -> DataFrame:
    """One category per message through a batch provider; without one, by the rules.

    A failed batch gives no rows.
    """
    if provider is None:
        return classify_by_rules(messages)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for part in _batches(frame, batch_size):
                try:
                    answer = provider(dict(zip(part["id"], part["content"].str.slice(0, max_chars))))
                except Exception:
                    continue
                rows += [(i, answer[i]) for i in part["id"] if i in answer]
            yield pd.DataFrame(rows, columns=["message_id", "category"])

    return messages.select("id", "content").mapInPandas(run, "message_id string, category string")


def classify_by_rules(messages: DataFrame, rules: Sequence[tuple[str, Sequence[str]]] = tuple(fv.CLASSIFICATION_RULES),
                      fallback: str = fv.FALLBACK_CATEGORY) -> DataFrame:
    """The first category, in rule order, with a cue in the lower-cased text."""
    rows = messages.select(F.col("id").alias("message_id"), "content")
    found = with_words(rows, "found", [cue for _, cues in rules for cue in cues])
    category = F.coalesce(
        *[F.when(F.arrays_overlap("found", word_array(cues)), F.lit(name)) for name, cues in rules], F.lit(fallback)
    )
    return found.select("message_id", category.alias("category"))


def parse_classifications(responses: DataFrame, categories: Sequence[str] = tuple(fv.TAXONOMY)) -> DataFrame:
    """JSON answers to (message_id, category, valid); a malformed answer gives no rows."""
    answers = F.explode_outer(F.from_json("response", "map<string,string>")).alias("message_id", "category")
    return responses.select(answers).filter(F.col("message_id").isNotNull()).withColumn(
        "valid", F.coalesce(F.col("category").isin(list(categories)), F.lit(False))
    )


def extract_keywords(df: DataFrame, vocab: Sequence[str] = tuple(fv.INTEGRATION_WORDS)) -> DataFrame:
    """Add ``keywords``: the vocabulary words that occur in the text as substrings, sorted."""
    return with_words(df, "keywords", vocab)


def extract_tools_and_pains(df: DataFrame, tools: Sequence[str] = tuple(fv.TOOL_WORDS),
                            pains: Sequence[str] = tuple(fv.PAIN_WORDS)) -> DataFrame:
    """Add ``tools``, ``pain_points`` and ``all``; a word of both lists counts twice in ``all``."""
    both = sorted({*tools, *pains})
    found = with_words(df, "__found", both)
    # One scan of the text for the union of the lists; the two lists are then cut from its short result.
    return (
        found.withColumn("tools", F.array_intersect("__found", word_array(tools)))
        .withColumn("pain_points", F.array_intersect("__found", word_array(pains)))
        .withColumn("all", F.concat("tools", "pain_points"))
        .drop("__found")
    )


def auto_categories(df: DataFrame, keyword_cues: Mapping[str, Sequence[str]] = fv.AUTO_KEYWORD_CUES,
                    text_cues: Mapping[str, Sequence[str]] = fv.AUTO_TEXT_CUES) -> DataFrame:
    """Add ``auto_categories``: all labels whose cues occur, sorted, or 'uncategorized'."""
    lowered = F.lower("content")
    labels = {name: F.arrays_overlap("keywords", word_array(cues)) for name, cues in keyword_cues.items()}
    for name, cues in text_cues.items():
        labels[name] = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(c)) for c in cues])
    found = F.array_compact(F.array(*[F.when(labels[name], F.lit(name)) for name in sorted(labels)]))
    return df.withColumn("auto_categories", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("uncategorized"))))


def cross_category_keywords(kw: DataFrame, min_categories: int = 3) -> DataFrame:
    """Keywords of at least ``min_categories`` categories with totals and a count per category."""
    word, present = explode_once(F.col("all"), "keyword")
    counts = kw.select("category", word).filter(present).groupBy("keyword", "category").agg(F.count("*").alias("n"))
    return (
        counts.groupBy("keyword")
        .agg(
            F.sum("n").alias("total_mentions"), F.count("*").alias("category_count"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("breakdown"),
        )
        .filter(F.col("category_count") >= min_categories)
    )


def with_themes(kw: DataFrame, themes: Mapping[str, Sequence[str]] = fv.THEMES) -> DataFrame:
    """One row per message row and theme that its words touch."""
    touched = [F.when(F.arrays_overlap("all", word_array(words)), F.lit(name)) for name, words in themes.items()]
    theme, present = explode_once(F.array_compact(F.array(*touched)), "theme")
    return kw.select("*", theme).filter(present)


def opportunity_themes(kw: DataFrame, themes: Mapping[str, Sequence[str]] = fv.THEMES,
                       categories: Sequence[str] | None = None) -> DataFrame:
    """Messages, distinct usernames and categories per theme.

    Grouped by (theme, username) first: a theme of a third of all messages is
    spread over its users, and no distinct count expands the rows.
    """
    rows = with_themes(kw.select("username", "category", "all"), themes)
    names = list(fv.TAXONOMY) if categories is None else list(categories)
    per_user = rows.groupBy("theme", "username").agg(F.count("*").alias("n"), F.bit_or(name_bit("category", names)).alias("bits"))
    sums = per_user.groupBy("theme").agg(
        F.sum("n").alias("messages"), F.count("*").alias("users"), F.bit_or("bits").alias("bits")
    )
    return sums.select("theme", "messages", "users", names_in_bits("bits", names).alias("categories"))


def theme_top_keywords(kw: DataFrame, themes: Mapping[str, Sequence[str]] = fv.THEMES, n: int = 20) -> DataFrame:
    """The most frequent keywords of each theme's messages; a keyword counts once per message."""
    rows = with_themes(kw.select("all"), themes)
    word, _ = explode_once(F.array_distinct("all"), "keyword")
    counts = rows.select("theme", word).groupBy("theme", "keyword").agg(F.count("*").alias("n"))
    return first_per(counts, ["theme"], [F.desc("n"), F.asc("keyword")], n).select("theme", "rank", "keyword", "n")


def run_throughput(batches: DataFrame) -> DataFrame:
    """Processed and failed messages and the rate per run, from one status row per batch."""
    ok = F.when(F.col("status") == "ok", F.col("n")).otherwise(0)
    return batches.groupBy("run_id").agg(
        F.sum(ok).alias("processed"), F.sum(F.col("n") - ok).alias("failed"),
        F.try_divide(F.sum(ok), F.max("finished_at") - F.min("started_at")).alias("per_second"),
    )
