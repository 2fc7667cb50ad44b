"""The corpus: all tables of one collection, as lazy DataFrames."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlens import schemas
from chatterlens.functions.columns import name_bit, names_in_bits, small
from chatterlens.functions.fixed_values import TAXONOMY
from chatterlens.functions.skew import spread_join


def taxonomy_dim(spark: SparkSession, taxonomy: dict[str, str] = TAXONOMY) -> DataFrame:
    """The categories as a table."""
    return spark.createDataFrame(list(taxonomy.items()), "name string, description string")


@dataclass(frozen=True)
class Corpus:
    """Tables of one collection. A missing table is simply None."""

    messages: DataFrame
    users: DataFrame
    message_taxonomy: DataFrame
    extracted_entities: DataFrame | None = None
    embeddings_reference: DataFrame | None = None
    clustering_runs: DataFrame | None = None
    message_clusters: DataFrame | None = None
    taxonomy_runs: DataFrame | None = None
    vectors: DataFrame | None = None
    categories: dict[str, str] = field(default_factory=lambda: dict(TAXONOMY))

    @property
    def spark(self) -> SparkSession:
        return self.messages.sparkSession

    @property
    def taxonomy(self) -> DataFrame:
        return small(taxonomy_dim(self.spark, self.categories), len(self.categories))

    def labels(self, categories: Sequence[str] | None = None) -> DataFrame:
        """Distinct (message_id, category) of known categories, partitioned by message.

        Grouping by message alone lets the join with messages reuse the shuffle,
        and the categories of a message travel as one long.
        """
        wanted = list(self.categories) if categories is None else list(categories)
        rows = self.message_taxonomy.filter(F.col("category").isin(wanted))
        if len(wanted) == 1:
            return rows.select("message_id").distinct().withColumn("category", F.lit(wanted[0]))
        return (
            rows.groupBy("message_id")
            .agg(F.bit_or(name_bit("category", wanted)).alias("bits"))
            .select("message_id", F.explode(names_in_bits("bits", wanted)).alias("category"))
        )

    def facts(self, categories: Sequence[str] | None = None, *columns: str) -> DataFrame:
        """One row per (message, category): id, author_id, category and the message columns asked for."""
        kept = dict.fromkeys(["id", "author_id", *columns])
        return (
            self.messages.select(*kept)
            .join(self.labels(categories).withColumnRenamed("message_id", "id"), "id")
        )

    def classified_messages(self, *columns: str) -> DataFrame:
        """Messages with any label, each once: the message nodes of the graph."""
        kept = dict.fromkeys(["id", *columns])
        return self.messages.select(*kept).join(
            self.message_taxonomy.select(F.col("message_id").alias("id")), "id", "left_semi"
        )

    def _labelled_replies(self) -> DataFrame:
        """(child_id, parent_id) of labelled replies, whatever the parent."""
        nodes = self.message_taxonomy.select(F.col("message_id").alias("child_id"))
        return (
            self.messages.filter(F.col("parent_id").isNotNull() & (F.col("parent_id") != ""))
            .select(F.col("id").alias("child_id"), "parent_id")
            .join(nodes, "child_id", "left_semi")
        )

    def reply_counts(self) -> DataFrame:
        """(parent_id, n) of labelled replies; counted first, so a much answered parent is one row."""
        counts = self._labelled_replies().groupBy("parent_id").agg(F.count("*").alias("n"))
        return counts.join(self.classified_messages().withColumnRenamed("id", "parent_id"), "parent_id", "left_semi")

    def replies(self) -> DataFrame:
        """Distinct (child_id, parent_id) where both ends carry a label."""
        pairs = self._labelled_replies()
        # One message may have drawn a large part of all replies.
        parents = self.classified_messages().withColumnRenamed("id", "parent_id")
        return spread_join(pairs, parents, "parent_id", "child_id", "left_semi").select("child_id", "parent_id")

    def authors(self, *columns: str) -> DataFrame:
        """Users keyed for joins with facts."""
        return self.users.select(F.col("id").alias("author_id"), *columns)

    def fetch(self, keys: DataFrame, max_rows: int, *columns: str) -> DataFrame:
        """Add wide message columns to few rows that were picked by id alone."""
        return self.messages.select("id", *columns).join(small(keys, max_rows), "id")


# The column each table is joined on most.
JOIN_KEYS = {
    "messages": "id", "users": "id", "message_taxonomy": "message_id", "extracted_entities": "message_id",
    "embeddings_reference": "message_id", "message_clusters": "message_id", "vectors": "message_id",
}


def save_bucketed(g: Corpus, prefix: str, buckets: int, folder: str | None = None) -> None:
    """Write the tables bucketed and sorted by their join key, as catalog tables ``<prefix>_<table>``.

    Joins of messages with labels, entities or vectors then need no shuffle, so
    texts never leave the task that reads them. Size ``buckets`` so that one
    bucket of messages fits a task.
    """
    for name in schemas.TABLES:
        df = getattr(g, name)
        if df is None:
            continue
        writer = df.write.mode("errorifexists").format("parquet")
        if name in JOIN_KEYS:
            writer = writer.bucketBy(buckets, JOIN_KEYS[name]).sortBy(JOIN_KEYS[name])
        if folder is not None:
            writer = writer.option("path", posixpath.join(folder, name))
        writer.saveAsTable(f"{prefix}_{name}")


def read_bucketed(spark: SparkSession, prefix: str) -> Corpus:
    """Open the tables written by ``save_bucketed``."""
    names = [n for n in schemas.TABLES if spark.catalog.tableExists(f"{prefix}_{n}")]
    return Corpus(**{n: spark.table(f"{prefix}_{n}") for n in names})


def read_corpus(spark: SparkSession, folder: str, register: bool = False) -> Corpus:
    """Open every table under a folder of Parquet tables with its fixed schema."""
    frames = {}
    for name, schema in schemas.TABLES.items():
        try:
            frames[name] = spark.read.schema(schema).parquet(posixpath.join(folder, name))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if register:
            frames[name].createOrReplaceTempView(name)
    return Corpus(**frames)
