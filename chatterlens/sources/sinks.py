"""File outputs. Each task writes its own files; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlens.functions.columns import utc_timestamp


def message_export(messages_with_author: DataFrame) -> DataFrame:
    """The columns of the CSV export, newest first."""
    return messages_with_author.orderBy(F.desc("timestamp"), "id").select(
        "content", "platform",
        F.date_format(utc_timestamp("timestamp"), "yyyy-MM-dd HH:mm").alias("date"),
        "source", "username", F.col("message_count").alias("user_msg_count"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes inside texts are doubled so that line breaks survive."""
    df.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def report_rows(enriched: DataFrame) -> DataFrame:
    """Nested report rows from messages with author, keywords and labels."""
    return enriched.select(
        "id", "content", "platform", "timestamp",
        F.date_format(utc_timestamp("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("date"),
        "source",
        F.struct(F.col("username"), F.col("message_count").alias("total_messages")).alias("user"),
        F.col("keywords").alias("extracted_keywords"),
        "auto_categories",
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_cluster_samples(samples: DataFrame, path: str) -> None:
    """One JSON row per cluster with its size and samples; the sample count bounds each row."""
    write_json(
        samples.groupBy("cluster_id", "size").agg(
            F.sort_array(F.collect_list(F.struct("id", "platform", "source", "preview"))).alias("samples")
        ),
        path,
    )


def write_themes(themes: DataFrame, top_keywords: DataFrame, path: str) -> None:
    """One JSON row per theme: messages, users, categories and its most frequent keywords."""
    words = top_keywords.groupBy("theme").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword", "n"))), lambda w: F.struct(w["keyword"].alias("keyword"), w["n"].alias("n"))).alias("top_keywords")
    )
    write_json(themes.join(words, "theme", "left"), path)


def write_cross_patterns(cross: DataFrame, path: str) -> None:
    """One JSON row per keyword that spans several categories, with its counts per category."""
    write_json(cross, path)
