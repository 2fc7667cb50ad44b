"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlens.session import ensure_checkpoint_dir, ship_package

BATCH_BYTES = 4 << 20  # Arrow batches sent to Python stay about this small, however long the texts are
__all__ = ["Memory", "fresh_name", "map_texts", "row_key", "shared_folder", "small_batches", "table", "written"]


def small_batches(spark: SparkSession) -> None:
    """Send the package to the workers, and bound the Arrow batches by bytes, so that memory does not follow the text lengths."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet into the shared folder and read again: compressed, and it survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """The name with as many underscores as it takes to differ from every column of the frame, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Memory:
    """What a worker remembers of words, in two generations of at most ``limit``: rare words are forgotten, common ones stay."""

    def __init__(self, limit: int, longest: int = 128):
        self.limit, self.longest = limit, longest
        self.now: dict = {}
        self.before: dict = {}

    def missing(self, words: Iterable) -> list:
        """The words it doesn't know; what it knows of the others is in ``now`` afterwards."""
        new = []
        for word in set(filterfalse(self.now.__contains__, words)):
            if word in self.before:
                self.now[word] = self.before[word]
            else:
                new.append(word)
        return new

    def settle(self, new: list) -> None:
        """After a batch: forget its very long words, and all of the older generation once the younger one is full."""
        for word in new:
            if len(word) > self.longest:
                del self.now[word]
        if len(self.now) > self.limit:
            self.before, self.now = self.now, {}


def row_key(*columns: str) -> Column:
    """A hash of the named columns; with the id beside it, it tells rows apart that share an id but nothing else."""
    return F.xxhash64(*[F.col(c) for c in columns])


def map_texts(
    docs: DataFrame, id_col: str, text_col: str, work: Callable[[], Callable[[list], dict]], fields: str, key: Column | None = None
) -> DataFrame:
    """One output row per document: the id, then the columns ``fields`` that the worker's function gives for the texts.

    With ``key`` (a long) each row carries it along, as ``row_key``.

    ``work()`` runs once per task and returns ``function(texts) -> {column: values}``; a null text arrives as an
    empty one. Only the two named columns are read, so further columns of any name do no harm.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pair = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([] if key is None else [key.alias("row_key")]))
    id_type = pair.schema["id"].dataType.simpleString()
    names = [f.split()[0] for f in fields.split(", ")]
    carried = ["row_key"] * (key is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = work()
        for batch in batches:
            if batch.num_rows:
                made = function(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[n]) for n in names), *batch.columns[2:]], names=["id", *names, *carried])

    return pair.mapInArrow(run, f"id {id_type}, {fields}" + ", row_key long" * len(carried)).withColumnRenamed("id", id_col)
