"""An inverted file for approximate vector search.

Pivots come from a bounded sample. Every vector is written into the folder of its nearest pivot, beside a code of one
byte per dimension: its difference to the pivot in steps of the row's own size. A search reads the codes of the nearest
folders only, keeps ``refine * k`` rows per query by their coded distance, and reads the whole vectors of those.
Distance is squared Euclidean; ties rank by message id.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlens.functions.columns import first_per
from chatterlens.operators.vectors import matrix

SLICE_ROWS = 8192  # rows, and queries, that one task compares at a time
STEPS = 127


@dataclass(frozen=True)
class InvertedFile:
    """The pivots, the folder of the vectors, and per pivot the rows and the greatest distance to it."""

    pivots: np.ndarray
    path: str
    cells: Mapping[int, tuple[int, float]]

    def rows(self, like: DataFrame) -> DataFrame:
        return like.sparkSession.read.parquet(self.path)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T))


def _centres(points: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """Centres of a bounded sample: evenly spread rows, moved to the mean of what is nearest."""
    centres = points[np.linspace(0, len(points) - 1, n).astype(int)]
    for _ in range(rounds):
        nearest = _squares(points, centres).argmin(axis=1)
        for j in np.unique(nearest):
            centres[j] = points[nearest == j].mean(axis=0)
    return np.unique(centres, axis=0)


def build_inverted_file(vectors: DataFrame, folder: str, pivots: int | None = None, sample: int = 4096) -> InvertedFile:
    """Index all vectors below ``folder``; the pivots are fitted on the ``sample`` rows with the smallest id hashes.

    By default there is one pivot per about a thousand vectors, 256 at most.
    """
    given = vectors.select("message_id", "embedding").filter(F.col("embedding").isNotNull())
    n = given.count()
    rows = given.orderBy(F.xxhash64("message_id"), "message_id").limit(sample).select("embedding").collect()
    some = np.array([r["embedding"] for r in rows], dtype="float64")
    if not len(some):
        raise ValueError("there are no vectors to index")
    centres = _centres(some, min(len(some), pivots or max(1, min(256, n // 1000 + 1))))
    dims = centres.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = matrix(batch.column(1), dims)
            apart = _squares(table, centres)
            cell = apart.argmin(axis=1)
            rest = table - centres[cell]
            step = np.abs(rest).max(axis=1) / STEPS
            codes = np.round(rest / np.where(step > 0, step, 1.0)[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(np.sqrt(apart.min(axis=1))), pa.array(step),
                pa.array([c.tobytes() for c in codes], pa.binary()),
            ], names=["message_id", "embedding", "pivot", "away", "step", "code"])

    kind = given.schema["embedding"].dataType.simpleString()
    placed = given.mapInArrow(assign, f"message_id string, embedding {kind}, pivot int, away double, step double, code binary")
    path = f"{folder}/inverted"
    # A crowded pivot is written by several tasks.
    placed.repartition("pivot", F.pmod(F.xxhash64("message_id"), F.lit(max(1, n // (SLICE_ROWS * 16))))).write.mode("overwrite").partitionBy("pivot").parquet(path)
    written = vectors.sparkSession.read.parquet(path)
    cells = {r["pivot"]: (r["n"], r["far"]) for r in written.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("far")).collect()}
    return InvertedFile(centres, path, cells)


def search_inverted(index: InvertedFile, queries: DataFrame, k: int = 10, probes: int | None = None, refine: int = 4) -> DataFrame:
    """query_id, rank, message_id, distance, codes_read: about the k nearest vectors to each (query_id, embedding).

    ``probes`` folders are read per query, all of them when it is None; a folder whose bound (distance to the pivot less
    its greatest row distance) is worse than the k-th distance among the rows already certain is of no use and left out.
    """
    if k < 1 or refine < 1 or (probes is not None and probes < 1):
        raise ValueError("k, probes and refine are at least 1")
    centres, dims = index.pivots, index.pivots.shape[1]
    cells = np.array(sorted(index.cells))
    sizes = np.array([index.cells[c][0] for c in cells])
    reach = np.array([index.cells[c][1] for c in cells])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = np.sqrt(_squares(matrix(batch.column(1), dims), centres[cells]))
            order = np.argsort(apart, axis=1, kind="stable")[:, : probes or len(cells)]
            near, far = np.maximum(0, apart - reach), apart + reach
            # In folders by their far ends, k rows lie within this distance.
            by_far = np.argsort(far, axis=1)
            enough = (np.cumsum(sizes[by_far], axis=1) < k).sum(axis=1).clip(max=len(cells) - 1)
            within = np.take_along_axis(far, by_far, axis=1)[np.arange(len(far)), enough]
            useful = np.take_along_axis(near, order, axis=1) <= within[:, None] + 1e-9
            row, column = np.nonzero(useful)
            read = (sizes[order] * useful).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(cells[order[row, column]], pa.int32()), pa.array(read[row])],
                names=["query_id", "embedding", "pivot", "codes_read"])

    kind = queries.schema["embedding"].dataType.simpleString()
    asked = queries.select("query_id", "embedding").mapInArrow(choose, f"query_id string, embedding {kind}, pivot int, codes_read long")
    # Rows and queries of one folder meet in tiles of bounded size, however crowded the folder is.
    row_slices, n_queries = max(1, -(-int(sizes.max()) // SLICE_ROWS)), queries.count()
    query_slices = max(1, -(-n_queries // SLICE_ROWS))
    part = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = index.rows(queries)
    left = stored.select("pivot", "message_id", "step", "code", part("message_id", row_slices).alias("r"), every(query_slices).alias("q"))
    right = asked.select("pivot", "query_id", "embedding", part("query_id", query_slices).alias("q"), every(row_slices).alias("r"))
    kept = refine * k

    def compare(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        made = {"query_id": [], "message_id": [], "coded": []}
        if rows.num_rows and wanted.num_rows:
            raw = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(rows.num_rows, dims)
            coded = raw * rows.column("step").to_numpy()[:, None]
            ids, names = rows.column("message_id").to_numpy(), wanted.column("query_id").to_numpy()
            points = matrix(wanted.column("embedding").combine_chunks(), dims) - centres[rows.column("pivot")[0].as_py()]
            by_id = np.argsort(np.argsort(ids.astype(str)))
            for start in range(0, len(names), 256):
                # Rounded, so that copies tie and the smaller ids are kept.
                apart = np.round(_squares(points[start : start + 256], coded), 9)
                last = np.partition(apart, kept - 1, axis=1)[:, kept - 1] if len(ids) > kept else np.full(len(apart), np.inf)
                for name, line, bound in zip(names[start : start + 256], apart, last):
                    some = np.flatnonzero(line <= bound)
                    best = some[np.lexsort((by_id[some], line[some]))[:kept]]
                    made["query_id"].append(np.full(len(best), name))
                    made["message_id"].append(ids[best])
                    made["coded"].append(line[best])
        kinds = {"query_id": pa.string(), "message_id": pa.string(), "coded": pa.float64()}
        return pa.table({name: pa.array(np.concatenate(parts) if parts else [], kinds[name]) for name, parts in made.items()})

    tiles = left.groupBy("pivot", "r", "q").cogroup(right.groupBy("pivot", "r", "q"))
    found = tiles.applyInArrow(compare, "query_id string, message_id string, coded double")
    close = first_per(found, ["query_id"], [F.asc("coded"), F.asc("message_id")], kept).select("query_id", "message_id")
    point = queries.select("query_id", F.col("embedding").alias("point"))
    gap = F.zip_with("point", "embedding", lambda a, b: a.cast("double") - b.cast("double"))
    exact = (
        close.join(stored.select("message_id", "embedding"), "message_id").join(point, "query_id")
        .select("query_id", "message_id", F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x).alias("distance"))
    )
    reads = asked.groupBy("query_id").agg(F.max("codes_read").alias("codes_read"))
    return first_per(exact, ["query_id"], [F.asc("distance"), F.asc("message_id")], k).join(reads, "query_id").select(
        "query_id", "rank", "message_id", "distance", "codes_read")


def vector_search_approx(index: InvertedFile, vectors: DataFrame, queries: Mapping[str, Sequence[float]], k: int = 10, probes: int | None = None,
                         refine: int = 4) -> DataFrame:
    """``search_inverted`` for a few query vectors."""
    rows = [(name, list(map(float, point))) for name, point in queries.items()]
    return search_inverted(index, vectors.sparkSession.createDataFrame(rows, "query_id string, embedding array<double>"), k, probes, refine)
