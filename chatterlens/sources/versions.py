"""Tables that grow by small batches: one base folder, a few delta folders, and a manifest that names the base.

Every batch writes its own delta folder and replaces nothing else, so a replayed batch changes nothing. When
``max_deltas`` have come together, base and deltas merge into a new base and a new manifest is put in place; readers see
the old state or the new one, and open a bounded number of folders however many batches there were. What a manifest no
longer names goes at the next merge, so that readers of the former state can finish.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "_epoch"


class VersionedTable:
    """``merge`` turns rows of all versions (with their ``_epoch``) into the table's rows, with the same columns.

    Epochs of one ``run`` (one stream with its checkpoint folder) grow; another run has its own.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, merge: Callable[[DataFrame], DataFrame], max_deltas: int = 16,
                 partition_by: Sequence[str] = ()):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), f"{schema}, {EPOCH} long"
        self.merge, self.max_deltas, self.partition_by = merge, max_deltas, list(partition_by)
        self._files = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._files.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def manifest(self) -> dict:
        """The newest one: the base folder's name, the last epoch in it by run, and folders that are no longer read."""
        names = [n for n in self._names("manifest") if n.endswith(".json")]
        if not names:
            return {"number": 0, "base": None, "upto": {}, "old": []}
        stream = self._fs.open(self._path(f"manifest/{names[-1]}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put_manifest(self, content: dict) -> None:
        name = f"manifest/{content['number']:012d}.json"
        draft = self._path(f"{name}.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        if not self._fs.rename(draft, self._path(name)):
            raise RuntimeError(f"another writer has put {name} in place")

    def deltas(self) -> list[tuple[str, int, str]]:
        """(run, epoch, folder) of the finished deltas that are not in the base."""
        upto = self.manifest()["upto"]
        found = []
        for name in self._names("delta"):
            run, epoch = name.rsplit("-", 1)
            if int(epoch) > upto.get(run, -1) and self._fs.exists(self._path(f"delta/{name}/_SUCCESS")):
                found.append((run, int(epoch), f"delta/{name}"))
        return found

    def folders(self) -> list[str]:
        """What a reader opens."""
        base = self.manifest()["base"]
        return ([base] if base else []) + [folder for _, _, folder in self.deltas()]

    def versions(self, where: Column | None = None) -> DataFrame:
        """Rows of all versions. A condition on the partition columns is met by opening their folders only."""
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.root}/{folder}") for folder in self.folders()]
        parts = [p if where is None else p.filter(where) for p in parts]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def read(self, where: Column | None = None) -> DataFrame:
        return self.merge(self.versions(where)).drop(EPOCH)

    def write(self, rows: DataFrame, epoch: int, run: str = "main") -> None:
        """Add a batch. The same epoch again replaces its delta, or changes nothing if it was merged."""
        if epoch <= self.manifest()["upto"].get(run, -1):
            return
        self._save(rows.withColumn(EPOCH, F.lit(epoch).cast("long")), f"delta/{run}-{epoch}")
        if len(self.deltas()) >= self.max_deltas:
            self.compact()

    def _save(self, rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").partitionBy(*self.partition_by).parquet(f"{self.root}/{folder}")

    def compact(self) -> None:
        """Merge base and deltas into a new base."""
        before, live = self.manifest(), self.deltas()
        if not live:
            return
        base = f"base/{uuid.uuid4().hex}"
        self._save(self.merge(self.versions()), base)
        upto = dict(before["upto"])
        for run, epoch, _ in live:
            upto[run] = max(epoch, upto.get(run, -1))
        gone = ([before["base"]] if before["base"] else []) + [folder for _, _, folder in live]
        self._put_manifest({"number": before["number"] + 1, "base": base, "upto": upto, "old": gone})
        for folder in before["old"]:
            self._fs.delete(self._path(folder), True)

    def mark(self, name: str) -> bool:
        """Leave a mark; False if it was there."""
        return self._fs.createNewFile(self._path(f"marks/{name}"))


def newest(keys: Sequence[str], *order: str) -> Callable[[DataFrame], DataFrame]:
    """The merge that keeps the last row per key by the named columns; equal ones are settled by the whole row."""

    def merge(rows: DataFrame) -> DataFrame:
        whole = F.struct(*[F.col(c) for c in rows.columns])
        last = F.max_by(whole, F.struct(*[F.col(c) for c in order], whole)).alias("__row")
        return rows.groupBy(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]).agg(last).select("__row.*")

    return merge
