"""Structured Streaming forms of ingest, activity and classification."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, StructField, StructType

from chatterlens.functions.columns import utc_timestamp
from chatterlens.operators.enrich import classify_by_rules
from chatterlens.operators.ingest import first_by_key
from chatterlens.sources.versions import EPOCH, VersionedTable, newest


def event_time(messages: DataFrame) -> DataFrame:
    return messages.withColumn("event_time", F.timestamp_seconds("timestamp"))


def stream_ingest_dedup(spark: SparkSession, folder: str, schema: str, normalizer: Callable[[DataFrame], DataFrame],
                        watermark: str = "2 days") -> DataFrame:
    """New raw files as message rows, each id once within the watermark.

    For live streams: rows older than the watermark are late and leave the stream.
    ``incremental_ingest`` keeps rows of any age.
    """
    rows = normalizer(spark.readStream.schema(schema).json(folder))
    return event_time(rows).withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["id"]).drop("event_time")


def known_ids(spark: SparkSession, target: str, buckets: int = 64) -> VersionedTable:
    """The ledger of a target's ids, in buckets by their hash."""
    return VersionedTable(spark, f"{target}.known", "id string, bucket int", lambda rows: rows.dropDuplicates(["id"]), partition_by=["bucket"])


def append_new(target: str, key: str = "id", run: str = "main", buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A batch writer that adds only keys the target lacks; a replayed batch adds nothing.

    Any known key counts, whatever its time: a ledger beside the target holds the keys in ``buckets`` hash buckets, and a
    batch reads its own buckets only. Rows are written first, their keys last; a batch that failed between the two is
    known by its mark, and when it is played again the target's days are looked at as well. The target is partitioned by
    UTC day for its readers. ``run`` tells streams with different checkpoint folders apart.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        ledger = known_ids(spark, target, buckets)
        columns = [*batch.columns, "day"]
        bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
        rows = first_by_key(batch.withColumn("day", F.to_date(utc_timestamp("timestamp"))), key, F.col("timestamp"), F.col("content"))
        rows = rows.withColumn("bucket", bucket).persist()
        try:
            touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
            if not touched:
                return
            stored = _stored(spark, target, StructType([*batch.schema.fields, StructField("day", DateType())]))
            if stored is not None and not ledger.folders():
                # A target from before there was a ledger.
                ledger.write(stored.select(F.col(key).cast("string").alias("id")).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")), 0, "before")
            known = ledger.versions(F.col("bucket").isin(touched)).select(F.col("id").alias(key))
            fresh = rows.join(known, key, "left_anti").persist()
            try:
                written = fresh
                if not ledger.mark(f"{run}-{epoch}") and stored is not None:
                    span = fresh.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
                    near = stored.filter(F.col("day").isNull() | F.col("day").between(F.lit(span["a"]), F.lit(span["b"])))
                    written = fresh.join(near.select(key), key, "left_anti")
                written.select(*columns).write.mode("append").partitionBy("day").parquet(target)
                ledger.write(fresh.select(F.col(key).cast("string").alias("id"), "bucket"), epoch, run)
            finally:
                fresh.unpersist()
        finally:
            rows.unpersist()

    return write


def _stored(spark: SparkSession, target: str, schema: StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(target)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def incremental_ingest(spark: SparkSession, landing: str, target: str, checkpoint: str, schema: str,
                       normalizer: Callable[[DataFrame], DataFrame], files_per_batch: int | None = None) -> StreamingQuery:
    """Collect what has arrived since the last run and stop; the checkpoint folder remembers the position.

    Collectors walk back in time, so old messages may arrive late. No watermark is
    used here: every row is kept, and the writer alone makes ids unique.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        normalizer(reader.json(landing)).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(append_new(target, run=hashlib.sha256(checkpoint.encode()).hexdigest()[:16])).start()
    )


def merge_updates(target: str, key: str = "author_id", max_deltas: int = 16) -> Callable[[DataFrame, int], None]:
    """A batch writer for update mode: each batch adds the changed rows; see ``latest_updates``."""

    def write(batch: DataFrame, epoch: int) -> None:
        VersionedTable(batch.sparkSession, target, _ddl(batch), newest([key], EPOCH), max_deltas).write(batch, epoch)

    return write


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def latest_updates(spark: SparkSession, target: str, schema: str, key: str) -> DataFrame:
    """The newest row per key of a table written by ``merge_updates``; old batches are merged, so few folders are read."""
    return VersionedTable(spark, target, schema, newest([key], EPOCH)).read()


ACTIVITY = "id string, platform string, message_count long, first_seen long, last_seen long, latest struct<timestamp:bigint,message:string,username:string>"


def activity_store(spark: SparkSession, target: str, max_deltas: int = 16) -> VersionedTable:
    """Message counts and times per author that grow with each ingest.

    A batch of new messages adds its partial aggregates; counts add up, times and names take the extremes, so any split
    of the messages into batches gives what ``user_activity_rollup`` gives over all of them.
    """

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id", "platform").agg(
            F.sum("message_count").alias("message_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
            F.max("latest").alias("latest"), F.max(EPOCH).alias(EPOCH))

    return VersionedTable(spark, target, ACTIVITY, merge, max_deltas)


def add_activity(target: str, names: str | None = None, run: str = "main", max_deltas: int = 16) -> Callable[[DataFrame, int], None]:
    """A batch writer of new messages into ``activity_store``; a replayed batch counts once."""

    def write(batch: DataFrame, epoch: int) -> None:
        name = F.col(names) if names else F.col("author_id")
        latest = F.struct(F.col("timestamp").cast("long").alias("timestamp"), F.col("id").alias("message"), name.alias("username"))
        partial = batch.groupBy(F.col("author_id"), "platform").agg(
            F.count("*").alias("message_count"), F.min("timestamp").cast("long").alias("first_seen"), F.max("timestamp").cast("long").alias("last_seen"),
            F.max(latest).alias("latest")).withColumnRenamed("author_id", "id")
        activity_store(batch.sparkSession, target, max_deltas).write(partial, epoch, run)

    return write


def stored_activity(spark: SparkSession, target: str) -> DataFrame:
    """id, platform, username, message_count, first_seen, last_seen of what ``add_activity`` has written."""
    return activity_store(spark, target).read().select("id", "platform", F.col("latest.username").alias("username"), "message_count", "first_seen", "last_seen")


def stream_user_activity(messages: DataFrame) -> DataFrame:
    """Running message count, first and last time per author; for update mode."""
    return messages.groupBy("author_id").agg(
        F.count("*").alias("message_count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    )


def stream_daily_category_counts(labelled: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Messages per UTC day and category; a day is final once the watermark has passed it."""
    return (
        event_time(labelled).withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", "1 day").alias("day"), "category").agg(F.count("*").alias("n"))
        .select(F.col("day.start").alias("day_start"), "category", "n")
    )


def stream_classify(messages: DataFrame) -> DataFrame:
    """Rule categories of arriving messages; stateless."""
    return classify_by_rules(messages)
