"""Hard negatives by a multiway hyperplane tree with sibling ranges (``gnat``).

The root's split points come from a bounded sample; every row goes to the nearest of them, and rows of one cell are dealt
into blocks of about ``BLOCK`` rows, so that a cell of any size, copies too, is spread. Each block is a tree of its own;
it is written with its distance ranges to all root points, which let whole blocks be left out.

Anchors travel in blocks, too, ordered by cell. A task holds a few trees and meets a bounded number of anchor blocks,
whose best rows so far narrow their annuli from tree to tree. First each anchor's positives are searched, then, with the
windows that their scores give, its negatives.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; shorter
vectors count as filled up with zeros; rows that share an id are separate rows, but an anchor never meets a row of its
own id, and each anchor row has its own results; ties go to the smaller id; anchors without positives, and positives
without negatives, give no rows; an empty table gives none; further columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlens.llm.base import small_batches, written
from chatterlens.llm.gnat import Search, Tree, distances, far_apart, lift, reachable
from chatterlens.llm.topk import integers, usable

ROOT_POINTS = 32
SAMPLE = 2048  # rows from which the root points are chosen
BLOCK = 4096  # rows of a tree
ANCHORS = 256  # anchors of a block
TREES, ANCHOR_BLOCKS = 4, 64  # what one task holds, and what it meets


def _table(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as a matrix, filled up with zeros."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    made = np.zeros((len(column), width), np.int64)
    lengths = np.diff(offsets)
    made[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
    return made


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """The rows with ``block``: every cell is cut into blocks of about ``size`` rows by a hash of the row number."""
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # at most ROOT_POINTS rows
    offset, cells = 0, []
    for cell in range(max(counts, default=-1) + 1):
        parts = -(-counts.get(cell, 0) // size)
        cells.append((offset, max(1, parts)))
        offset += parts
    first, parts = (F.array(*[F.lit(c[i]) for c in cells or [(0, 1)]])[F.col("cell")] for i in (0, 1))
    return rows.withColumn("block", (first + F.pmod(F.xxhash64("row"), parts)).cast("int"))


class _Space:
    """What all vectors have in common: width, greatest squared length, root points."""

    def __init__(self, width: int, square: int, largest: int, sample: list[list[int]]):
        self.width, self.square = width, square
        self.exact = largest * largest * max(1, width) < 1 << 53
        rows = np.zeros((len(sample), width), np.int64)
        for row, v in zip(rows, sample):
            row[: len(v)] = v
        lifted = lift(rows, square)
        self.points = lifted[far_apart(lifted, ROOT_POINTS)] if len(sample) else lifted

    def cells(self, rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    table = _table(batch.column("v"), self.width)
                    cell = distances(lift(table, self.square), self.points).argmin(axis=1)
                    yield batch.append_column("cell", pa.array(cell, pa.int32()))

        return rows.mapInArrow(run, "row long, id long, label long, v array<long>, asked boolean, cell int")

    def trees(self, rows: DataFrame) -> DataFrame:
        """One row per block: its tree, and its distance ranges to the root points."""

        def run(group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            table = _table(group.column("v").chunk(0), self.width)
            apart = distances(self.points, lift(table, self.square))
            tree = Tree.build(group.column("id").to_numpy(), group.column("label").to_numpy(), table, self.square)
            return pa.table({
                "block": group.column("block").slice(0, 1), "tree": [tree.to_bytes()], "least": [apart.min(axis=1)], "greatest": [apart.max(axis=1)],
            })

        return rows.select("block", "id", "label", "v").groupBy("block").applyInArrow(
            run, "block int, tree binary, least array<double>, greatest array<double>")

    def questions(self, anchors: DataFrame) -> DataFrame:
        """Anchors packed in blocks; ``slots`` are lists of (low, high), one per place."""

        def run(group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            slots = group.column("slots").to_pylist()
            flat = [(i, place, s["low"], s["high"]) for i, mine in enumerate(slots) for place, s in enumerate(mine) if s["low"] <= s["high"]]
            query, place, low, high = np.array(flat, np.int64).reshape(-1, 4).T
            out = io.BytesIO()
            np.savez(
                out, row=group.column("row").to_numpy(), ids=group.column("id").to_numpy(), labels=group.column("label").to_numpy(),
                rows=_table(group.column("v").chunk(0), self.width), query=query, place=place, low=low, high=high)
            return pa.table({"asked_block": group.column("block").slice(0, 1), "anchors": [out.getvalue()]})

        return anchors.select("block", "row", "id", "label", "v", "slots").groupBy("block").applyInArrow(run, "asked_block int, anchors binary")


def _best(space: _Space, trees: DataFrame, n_trees: int, questions: DataFrame, n_questions: int, k: int, same_label: bool) -> DataFrame:
    """(row, place, id, score, scored): of every slot the k best rows of each task; ``scored`` is one task's effort."""
    across, down = max(1, -(-n_trees // TREES)), max(1, -(-n_questions // ANCHOR_BLOCKS))
    tiles = trees.withColumn("g", F.col("block") % across).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    asked = questions.withColumn("h", F.col("asked_block") % down).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        built = [Tree.from_bytes(raw) for raw in left.column("tree").to_pylist()]
        ranges = np.array([left.column("least").to_pylist(), left.column("greatest").to_pylist()]).transpose(0, 2, 1) if built else None
        made = {name: [] for name in ("row", "place", "id", "score", "scored")}
        for raw in right.column("anchors").to_pylist() if built else ():
            with np.load(io.BytesIO(raw)) as f:
                q = dict(f)
            search = Search(q["ids"], q["labels"], q["rows"], q["query"], q["low"], q["high"], k, same_label, space.square, space.exact)
            everyone = np.unique(q["query"])
            if not len(everyone):
                continue
            least, greatest = reachable(distances(search.lifted[everyone], space.points), ranges)
            search.through(everyone, least, greatest, built)
            slot, found, score = search.results()
            for name, values in (("row", q["row"][q["query"][slot]]), ("place", q["place"][slot]), ("id", found), ("score", score)):
                made[name].append(values)
            made["scored"].append(np.where(np.arange(len(slot)) == 0, search.scored, 0))
        return pa.table({name: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64()) for name, parts in made.items()})

    best = tiles.groupBy("g", "h").cogroup(asked.groupBy("g", "h")).applyInArrow(run, "row long, place long, id long, score long, scored long")
    order = Window.partitionBy("row", "place").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 10, low_percent: int = 30,
                   high_percent: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Of each anchor's best rows of its own label, and of each of them, the best rows of other labels whose score lies from
    ``low_percent`` to ``high_percent`` of the positive's.
    """
    small_batches(vectors.sparkSession)
    given = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("raw"),
                           F.coalesce(anchors, F.lit(False)).alias("asked"))
    good = given.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("raw")))
    rows = written(good.select(F.monotonically_increasing_id().alias("row"), "id", "label", integers(F.col("raw"), scale).alias("v"), "asked"), "vectors")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    stats = rows.agg(F.max(F.size("v")), F.max(square), F.max(F.array_max(F.transform("v", F.abs)))).first()
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").collect()]
    space = _Space(stats[0] or 0, stats[1] or 0, stats[2] or 0, sample)
    placed = written(space.cells(rows), "cells")
    trees = written(space.trees(_dealt(placed, BLOCK)), "trees")
    asked = _dealt(placed.filter("asked"), ANCHORS)
    n_trees = trees.count()

    def search(with_slots: DataFrame, k: int, same_label: bool, name: str) -> DataFrame:
        questions = written(space.questions(with_slots), name)
        return _best(space, trees, n_trees, questions, questions.count(), k, same_label)

    widest = F.array(F.struct(F.lit(Search.NONE).alias("low"), F.lit(np.iinfo(np.int64).max).alias("high")))
    near = written(search(asked.withColumn("slots", widest), positives, True, "positive-questions"), "positives")
    # Floor and ceiling in whole numbers; the products may pass 64 bits.
    low, high = (F.lit(percent) * F.col("score").cast("decimal(20,0)") for percent in (low_percent, high_percent))
    bounds = near.select(
        "row", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.call_function("div", low + F.pmod(-low, F.lit(100)), F.lit(100)).alias("low"),
        F.call_function("div", high - F.pmod(high, F.lit(100)), F.lit(100)).alias("high"))
    slots = bounds.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))), lambda s: F.struct(s["low"], s["high"])).alias("slots"))
    hard = search(asked.join(slots, "row"), negatives, False, "negative-questions").withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    named = bounds.withColumn("place", (F.col("rank") - 1).cast("long")).drop("rank", "low", "high").join(placed.filter("asked").select("row", F.col("id").alias("anchor_id")), "row")
    return hard.join(named, ["row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
