"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

The vectors are dealt into blocks of bounded size; the index of a block holds its integer components and, for every
dimension, the rows in ascending order of that component. A query walks the lists of all its dimensions in steps, from
the end that favours it; rows seen for the first time get their score by random access. The bound on any unseen row is
the sum over the dimensions of the query's component times the list's present value; the walk of a block stops once the
bound is below the k-th best score so far (an equal bound goes on, as an unseen row might win the tie by its id).

Query blocks travel to the candidate blocks, a few kilobytes per query; every pair of blocks is one row of work, and
the k best per query and block merge in one small aggregation.

Defined results: vectors that are null, hold a null or a non-finite component take no part; vectors of different
lengths count as filled up with zeros; empty vectors score 0; equal ids are separate rows, but a query never meets a
row of its own id; fewer than k candidates give fewer rows; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlens.llm.base import small_batches, written

CANDIDATES = 8192  # rows of a candidate block
QUERIES = 1024  # queries of a query block
FIRST_DEPTH = 32


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def packed(frame: DataFrame, block: str, number: int) -> DataFrame:
    """One row per block: its ids and its rows as binary arrays."""

    def run(groups: pa.Table) -> pa.Table:
        vectors = groups.column("v").to_pylist()
        width = max(map(len, vectors), default=0)
        matrix = np.zeros((len(vectors), width), np.int64)
        for row, v in zip(matrix, vectors):
            row[: len(v)] = v
        kind = next((k for k in (np.int16, np.int32) if not matrix.size or np.abs(matrix).max() <= np.iinfo(k).max), np.int64)
        ids = groups.column("id").to_numpy().astype(np.int64)
        return pa.table({
            "block": pa.array([groups.column("block")[0].as_py()], pa.int32()), "width": pa.array([width], pa.int32()),
            "kind": [np.dtype(kind).str], "ids": [ids.tobytes()], "rows": [matrix.astype(kind).tobytes()],
        })

    dealt = frame.select(F.pmod(F.xxhash64("id"), F.lit(number)).cast("int").alias("block"), "id", "v")
    return dealt.groupBy("block").applyInArrow(run, "block int, width int, kind string, ids binary, rows binary").withColumnsRenamed(
        {c: f"{block}_{c}" for c in ("block", "width", "kind", "ids", "rows")})


class Lists:
    """The sorted lists of one candidate block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids = ids
        # Sums stay exact in floating point as long as no product sum can exceed 2^53.
        self.largest = int(np.abs(rows).max()) if rows.size else 0
        self.whole = rows
        self.rows = rows.astype(np.float64)
        self.order = np.argsort(rows, axis=0, kind="stable").T.copy()  # per dimension: rows by ascending component
        self.values = np.take_along_axis(rows, self.order.T, axis=0).T.copy() if rows.size else rows.T

    def score(self, some: np.ndarray | slice, query: np.ndarray) -> np.ndarray:
        if self.largest * int(np.abs(query).max(initial=0)) * max(1, len(query)) < 1 << 53:
            return (self.rows[some] @ query.astype(np.float64)).astype(np.int64)
        return self.whole[some].astype(np.int64) @ query

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows for one query, by the threshold algorithm."""
        n = len(self.ids)
        walked = np.flatnonzero(query)
        weights = query[walked]
        seen = np.zeros(n, bool)
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, step = 0, FIRST_DEPTH
        while depth < n and (len(walked) or depth == 0):
            upto = min(n, depth + step)
            if len(walked):
                up, down = walked[weights < 0], walked[weights > 0]
                fresh = np.zeros(n, bool)
                fresh[self.order[up, depth:upto].ravel()] = True
                fresh[self.order[down, n - upto : n - depth].ravel()] = True
                fresh &= ~seen
                met = np.flatnonzero(fresh)
                seen |= fresh
            else:
                met, upto = np.arange(n), n
            met = met[self.ids[met] != query_id]
            ids, scores = np.append(ids, self.ids[met]), np.append(scores, self.score(met, query))
            if len(ids) > k:
                top = np.lexsort((ids, -scores))[:k] if len(ids) < 64 else self._top(ids, scores, k)
                ids, scores = ids[top], scores[top]
            depth, step = upto, step * 4
            if depth < n and len(ids) == k:
                ends = np.where(weights < 0, self.values[walked, depth], self.values[walked, n - 1 - depth]).astype(np.int64)
                if int(ends @ weights) < scores.min():
                    break
        return ids, scores

    @staticmethod
    def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= bound)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]


def matrix(raw: bytes, kind: str, width: int, n: int, at_least: int = 0) -> np.ndarray:
    rows = np.frombuffer(raw, kind).reshape(n, width).astype(np.int64)
    return np.pad(rows, ((0, 0), (0, max(0, at_least - width))))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best rows for each row that satisfies ``queries``: query_id, rank, the row's id, score."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    counted = rows.agg(F.count("*").alias("n"), F.sum(F.col("asked").cast("long")).alias("q")).first()
    blocks, asked_blocks = -(-max(1, counted["n"]) // CANDIDATES), -(-max(1, counted["q"] or 1) // QUERIES)
    index = written(packed(rows.select("id", "v"), "c", blocks), "lists")
    # Each packed query block goes to every candidate block: a stated query set against all rows, in blocks.
    asked = packed(rows.filter("asked").select("id", "v"), "q", asked_blocks).withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    work = index.join(asked, "c_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lists = None, None
        for batch in batches:
            for r in batch.to_pylist():
                ids, query_ids = np.frombuffer(r["c_ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                width = max(r["c_width"], r["q_width"])
                if held != (r["c_block"], width):
                    held, lists = (r["c_block"], width), Lists(ids, matrix(r["c_rows"], r["c_kind"], r["c_width"], len(ids), width))
                questions = matrix(r["q_rows"], r["q_kind"], r["q_width"], len(query_ids), width)
                found = [lists.best(int(i), q, k) for i, q in zip(query_ids, questions)]
                sizes = [len(i) for i, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(query_ids, sizes)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))],
                    names=["query_id", id_col, "score"])

    best = work.mapInArrow(run, f"query_id long, `{id_col}` long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
