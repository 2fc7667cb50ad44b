"""Raw chat and forum records to message rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatterlens.functions.columns import col, strip
from chatterlens.functions.fixed_values import BOT_PATTERNS, REMOVED_TEXTS
from chatterlens.schemas import COMMENT_FIELDS

MESSAGE_COLUMNS = [
    "id", "platform", "content", "author_id", "author_name", "timestamp", "source", "parent_id", "metadata",
]


def is_bot_author(author: str | Column, patterns: Sequence[str] = BOT_PATTERNS) -> Column:
    """The lower-cased name contains a bot or moderator pattern anywhere; a missing name does not."""
    lowered = F.lower(col(author))
    hit = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(p)) for p in patterns])
    return F.coalesce(hit, F.lit(False))


def is_deleted(content: str | Column, author: str | Column) -> Column:
    """Missing or deleted author, or removed, deleted or empty text."""
    content, author = col(content), col(author)
    return (
        author.isNull()
        | (author == "[deleted]")
        | F.coalesce(content.isin([*REMOVED_TEXTS, ""]), F.lit(False))
    )


def filter_bot_authors(df: DataFrame, author_col: str, patterns: Sequence[str] = BOT_PATTERNS) -> DataFrame:
    return df.filter(~is_bot_author(author_col, patterns))


def filter_deleted(df: DataFrame, content_col: str, author_col: str) -> DataFrame:
    return df.filter(~is_deleted(content_col, author_col))


def filter_recent_months(df: DataFrame, as_of: int, months: int = 3) -> DataFrame:
    """Rows not older than months x 30 days before ``as_of`` (epoch seconds, UTC)."""
    return df.filter(F.col("timestamp") >= F.lit(as_of - months * 30 * 86400))


def drop_reason_chat() -> Column:
    """Why a raw chat record is dropped; null when it is kept."""
    empty = (
        (strip(F.coalesce("content", F.lit(""))) == "")
        & (F.coalesce(F.size("attachments"), F.lit(0)) <= 0)
        & (F.coalesce(F.size("embeds"), F.lit(0)) <= 0)
    )
    return (
        F.when(F.coalesce(F.col("author.bot"), F.lit(False)), "skipped_bots")
        .when(empty, "skipped_empty")
        .when(F.try_to_timestamp("timestamp").isNull(), "errors")
    )


def drop_reason_forum(content: str) -> Column:
    """Why a raw forum record is dropped; null when it is kept."""
    return (
        F.when(is_deleted(F.coalesce(F.col(content), F.lit("")), "author"), "skipped_deleted")
        .when(is_bot_author("author"), "skipped_bots")
    )


def normalize_chat(raw: DataFrame, source: str) -> DataFrame:
    """Chat records to message rows. Bots and records without any content are dropped."""
    metadata = F.to_json(
        F.struct(
            F.coalesce("type", F.lit(0)).alias("type"),
            F.col("edited_timestamp"),
            F.transform(F.coalesce("mentions", F.array()), lambda u: F.concat(F.lit("discord_"), u["id"])).alias("mentions"),
            F.coalesce("mention_roles", F.array()).alias("mention_roles"),
            F.coalesce("attachments", F.array()).alias("attachments"),
            F.greatest(F.coalesce(F.size("embeds"), F.lit(0)), F.lit(0)).alias("embeds"),
            F.transform(
                F.coalesce("reactions", F.array()),
                lambda r: F.struct(
                    r["emoji"]["name"].alias("emoji"), F.coalesce(r["count"], F.lit(0)).alias("count")
                ),
            ).alias("reactions"),
        )
    )
    parent = F.col("referenced_message.id")
    return raw.filter(drop_reason_chat().isNull()).select(
        F.concat(F.lit("discord_"), "id").alias("id"),
        F.lit("discord").alias("platform"),
        strip(F.coalesce("content", F.lit(""))).alias("content"),
        F.concat(F.lit("discord_"), F.col("author.id")).alias("author_id"),
        F.coalesce(F.col("author.username"), F.lit("Unknown")).alias("author_name"),
        F.unix_seconds(F.try_to_timestamp("timestamp")).alias("timestamp"),
        F.lit(source).alias("source"),
        F.when(parent.isNotNull(), F.concat(F.lit("discord_"), parent)).alias("parent_id"),
        metadata.alias("metadata"),
    )


def _awards() -> Column:
    return F.transform(F.coalesce("all_awardings", F.array()), lambda a: a["name"]).alias("awards")


def normalize_forum_posts(raw: DataFrame, source: str) -> DataFrame:
    """Forum posts to message rows: title, then the body after a blank line when there is one.

    A post with an empty body counts as removed, so link posts are dropped.
    """
    body = F.col("selftext")
    metadata = F.to_json(
        F.struct(
            F.lit("post").alias("type"),
            F.col("score").alias("upvotes"),
            F.col("upvote_ratio"),
            F.col("num_comments"),
            F.col("link_flair_text").alias("flair"),
            F.col("is_self").alias("is_self_post"),
            F.when(~F.col("is_self"), F.col("url")).alias("url"),
            F.concat(F.lit("https://reddit.com"), "permalink").alias("permalink"),
            _awards(),
            F.col("stickied").alias("is_stickied"),
            F.col("locked").alias("is_locked"),
        )
    )
    return raw.filter(drop_reason_forum("selftext").isNull()).select(
        F.concat(F.lit("reddit_t3_"), "id").alias("id"),
        F.lit("reddit").alias("platform"),
        F.concat_ws("\n\n", "title", F.when(strip(body) != "", body)).alias("content"),
        F.concat(F.lit("reddit_"), "author").alias("author_id"),
        F.col("author").alias("author_name"),
        F.col("created_utc").cast("bigint").alias("timestamp"),
        F.lit(source).alias("source"),
        F.lit(None).cast("string").alias("parent_id"),
        metadata.alias("metadata"),
    )


def normalize_forum_comments(raw: DataFrame, source: str) -> DataFrame:
    """Forum comments to message rows; the parent keeps its type prefix.

    Depth needs the whole thread: ``with_comment_depth`` fills it in.
    """
    metadata = F.to_json(
        F.struct(
            F.lit("comment").alias("type"),
            F.col("score").alias("upvotes"),
            F.when(F.col("parent_id").startswith("t3_"), 0).alias("depth"),
            F.col("parent_id").startswith("t3_").alias("is_top_level"),
            F.col("is_submitter"),
            F.concat(F.lit("https://reddit.com"), "permalink").alias("permalink"),
            _awards(),
        )
    )
    kept = raw.filter(drop_reason_forum("body").isNull()).filter(strip("body") != "")
    return kept.select(
        F.concat(F.lit("reddit_t1_"), "id").alias("id"),
        F.lit("reddit").alias("platform"),
        strip("body").alias("content"),
        F.concat(F.lit("reddit_"), "author").alias("author_id"),
        F.col("author").alias("author_name"),
        F.col("created_utc").cast("bigint").alias("timestamp"),
        F.lit(source).alias("source"),
        F.concat(F.lit("reddit_"), "parent_id").alias("parent_id"),
        metadata.alias("metadata"),
    )


def flatten_comment_tree(raw: DataFrame, max_levels: int) -> DataFrame:
    """Nested replies to one flat list of comments, in one select over one scan.

    Raises when the schema nests deeper than ``max_levels``: no reply is dropped silently.
    """
    fields = list(COMMENT_FIELDS)

    def levels(kind: T.StructType) -> int:
        return 1 + levels(kind["replies"].dataType.elementType) if "replies" in kind.names else 1

    if levels(raw.schema) > max_levels:
        raise ValueError(f"replies are nested deeper than {max_levels} levels")

    def comment(pick) -> Column:
        return F.struct(*[pick(f).alias(f) for f in fields])

    def flat(pick, kind: T.StructType) -> Column:
        """The comment itself and all comments below it, as one array."""
        own = F.array(comment(pick))
        if "replies" not in kind.names:
            return own
        inner = kind["replies"].dataType.elementType
        below = F.flatten(F.transform(pick("replies"), lambda r: flat(lambda f: r[f], inner)))
        return F.concat(own, F.coalesce(below, F.array().cast(T.ArrayType(own_type))))

    own_type = raw.select(comment(F.col).alias("c")).schema["c"].dataType
    return raw.select(F.explode(flat(F.col, raw.schema)).alias("c")).select("c.*")


def ingest_stats(raw: DataFrame, reason: Column, author: str | Column) -> DataFrame:
    """Records kept and dropped by reason, with distinct authors, in one pass."""
    return raw.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(
        F.count("*").alias("n"), F.count_distinct(col(author)).alias("authors")
    )


def parse_metadata(df: DataFrame, schema, column: str = "metadata") -> DataFrame:
    """Add ``parsed``; malformed JSON leaves it null and the raw text stays."""
    return df.withColumn("parsed", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
