"""Clustering of message vectors and scores of a labelling.

Input frames hold (message_id, embedding); labelled ones add cluster_id, with
-1 for noise.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlens.functions.columns import first_per, newest_first, pct, small
from chatterlens.session import written_once


def unit_features(v: DataFrame) -> DataFrame:
    """The frame with ``features``: its vectors scaled to length one; a zero vector stays as it is."""
    raw = v.withColumn("__raw", array_to_vector("embedding"))
    return Normalizer(inputCol="__raw", outputCol="features", p=2.0).transform(raw).drop("__raw")


def l2_normalize(v: DataFrame) -> DataFrame:
    """Vectors of length one, as arrays; a zero vector stays as it is."""
    return unit_features(v).withColumn("embedding", vector_to_array("features")).drop("features")


SAMPLE = 1000  # rows of a group from which the starting centres are drawn
TOLERANCE = 1e-4


@dataclass
class Fit:
    """One start of k-means in one group of rows; ``centres`` are those that ``cost`` was measured with."""

    group: str
    k: int
    centres: np.ndarray
    following: np.ndarray
    cost: float = float("inf")
    settled: bool = False


def _points(v: DataFrame, group: Column) -> DataFrame:
    """(group, message_id, features): unit vectors, written once and read by every round."""
    unit = l2_normalize(v.select(group.alias("group"), "message_id", "embedding"))
    return written_once(unit.select("group", "message_id", F.col("embedding").alias("features")))


def _starting_rows(points: DataFrame, most: int) -> dict[str, np.ndarray]:
    """Distinct unit vectors of each group: of ``SAMPLE`` rows, and of all rows where those hold fewer than ``most``."""
    def distinct(rows: DataFrame) -> dict[str, np.ndarray]:
        found: dict[str, list] = {}
        for r in rows.select("group", "features").collect():
            found.setdefault(r["group"], []).append(r["features"])
        return {g: np.unique(np.array(x), axis=0) for g, x in found.items()}

    n = max(SAMPLE, 4 * most)
    made = distinct(first_per(points, ["group"], [F.xxhash64("message_id"), F.asc("message_id")], n))
    short = [g for g, x in made.items() if len(x) < most]
    if short:
        several = points.filter(F.col("group").isin(short)).groupBy("group", F.xxhash64("features").alias("h")).agg(F.min_by("features", "message_id").alias("features"))
        made |= distinct(first_per(several, ["group"], [F.asc("h")], most))
    return made


def _spread_centres(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows, each drawn with a chance that grows with the squared distance to those before it."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(rows)))]
    gap = ((rows - rows[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        gap[chosen] = 0
        chosen.append(int(rng.choice(len(rows), p=gap / gap.sum())) if gap.sum() > 0 else next(i for i in range(len(rows)) if i not in chosen))
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen].copy()


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the squared distance to it."""
    gap = (centres * centres).sum(axis=1)[None] - 2 * (rows @ centres.T)
    at = gap.argmin(axis=1)
    return at, np.maximum(0.0, gap[np.arange(len(rows)), at] + (rows * rows).sum(axis=1))


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray]]:
    """Rows (group, message_id, features) of each batch and group, with their vectors as a matrix."""
    for batch in batches:
        for group in batch.column(0).unique().to_pylist():
            part = batch.filter(pc.equal(batch.column(0), group))
            flat = part.column(2).flatten().to_numpy(zero_copy_only=False)
            yield group, part, flat.reshape(part.num_rows, -1)


def _round(points: DataFrame, fits: list[Fit]) -> None:
    """One scan for all fits that still move: costs and new centres from one aggregate of (fit, cluster)."""
    live = [(i, f.group, f.following) for i, f in enumerate(fits) if not f.settled]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: [np.zeros(len(c)), np.zeros(len(c)), np.zeros_like(c)] for i, _, c in live}
        for group, _, rows in _by_group(batches):
            for i, of, centres in live:
                if of == group:
                    at, gap = _nearest(rows, centres)
                    mine = np.zeros((len(centres), len(rows)))
                    mine[at, np.arange(len(rows))] = 1.0
                    total[i][0] += mine.sum(axis=1)
                    total[i][1] += np.bincount(at, gap, minlength=len(centres))
                    total[i][2] += mine @ rows
        made = [(i, j, n, cost, s.tolist()) for i, (ns, costs, vs) in total.items() for j, (n, cost, s) in enumerate(zip(ns, costs, vs)) if n]
        columns = list(zip(*made)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())))], names=["fit", "cluster", "n", "cost", "sums"])

    parts = points.select("group", "message_id", "features").mapInArrow(sums, "fit int, cluster int, n double, cost double, sums array<double>")
    added = parts.groupBy("fit", "cluster").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), Summarizer.sum(array_to_vector("sums")).alias("sums"))
    moved = {i: centres.copy() for i, _, centres in live}
    costs = dict.fromkeys(moved, 0.0)
    # At most one row per fit and cluster.
    for r in added.collect():
        moved[r["fit"]][r["cluster"]] = r["sums"].toArray() / r["n"]
        costs[r["fit"]] += r["cost"]
    for i, _, centres in live:
        fit = fits[i]
        fit.centres, fit.cost, fit.following = centres, costs[i], moved[i]
        fit.settled = bool((((moved[i] - centres) ** 2).sum(axis=1) <= TOLERANCE**2).all())


def grouped_kmeans(points: DataFrame, ks: Mapping[str, Sequence[int]], seed: int, n_init: int, max_iter: int) -> dict[tuple[str, int], Fit]:
    """The best fit by (group, k). All starts of all ks in all groups move together, one scan of the points per round.

    What travels is one centre per start and cluster, so its size is set by the parameters. A fit that has settled takes
    no part in further rounds.
    """
    rows = _starting_rows(points, max((k for many in ks.values() for k in many), default=1))
    fits = []
    for group, many in sorted(ks.items()):
        for k in many:
            for start in range(n_init):
                centres = _spread_centres(rows[group], k, seed + start)
                fits.append(Fit(group, k, centres, centres))
    for _ in range(max_iter):
        if all(f.settled for f in fits):
            break
        _round(points, fits)
    best: dict[tuple[str, int], Fit] = {}
    for fit in fits:
        if (fit.group, fit.k) not in best or fit.cost < best[fit.group, fit.k].cost:
            best[fit.group, fit.k] = fit
    return best


def _labels(points: DataFrame, fits: Mapping[tuple[str, int], Fit]) -> DataFrame:
    """(message_id, group, k, cluster_id) of every point under every fit of its group, in one scan."""
    made = [(f.group, f.k, f.centres) for f in fits.values()]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, part, rows in _by_group(batches):
            for of, k, centres in made:
                if of == group:
                    at = _nearest(rows, centres)[0]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(1), part.column(0), pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32())], names=["message_id", "group", "k", "cluster_id"])

    return points.select("group", "message_id", "features").mapInArrow(label, "message_id string, group string, k int, cluster_id int")


def _distinct_vectors(points: DataFrame) -> dict[str, int]:
    """Distinct vectors of each group."""
    hashes = points.select("group", F.xxhash64("features").alias("h")).distinct()
    return {r["group"]: r["n"] for r in hashes.groupBy("group").agg(F.count("*").alias("n")).collect()}


def _enough(points: DataFrame, k: int) -> None:
    if k < 2:
        raise ValueError("k-means needs at least two clusters")
    there = points.select(F.xxhash64("features").alias("h")).distinct().limit(k).count()
    if there < k:
        raise ValueError(f"{k} clusters need as many distinct vectors; there are {there}")


def cluster_kmeans(v: DataFrame, k: int = 30, seed: int = 42, n_init: int = 10, max_iter: int = 20) -> tuple[DataFrame, float]:
    """k-means on unit vectors: the best of n_init starts, as (message_id, cluster_id) and its inertia.

    Raises when there are fewer distinct vectors than clusters.
    """
    points = _points(v, F.lit(""))
    _enough(points, k)
    fits = grouped_kmeans(points, {"": [k]}, seed, n_init, max_iter)
    return _labels(points, fits).select("message_id", "cluster_id"), fits["", k].cost


def with_vectors(labels: DataFrame, v: DataFrame) -> DataFrame:
    return v.select("message_id", "embedding").join(labels.select("message_id", "cluster_id"), "message_id")


def _unit(labelled: DataFrame) -> DataFrame:
    """Clustered rows with unit vectors; noise is left out of every score."""
    return l2_normalize(labelled.filter(F.col("cluster_id") != -1).select("message_id", "embedding", "cluster_id"))


def silhouette(labelled: DataFrame, metric: str = "cosine") -> DataFrame:
    """Mean silhouette of all rows, as one row: cosine or squared Euclidean distance of unit vectors.

    The evaluator needs only sums per cluster for both, so no pair of rows is compared.
    """
    points = _unit(labelled).select(array_to_vector("embedding").alias("features"), F.col("cluster_id").alias("prediction"))
    evaluator = ClusteringEvaluator(metricName="silhouette", distanceMeasure=metric)
    return labelled.sparkSession.createDataFrame([(float(evaluator.evaluate(points)),)], "silhouette double")


def _moments(rows: DataFrame) -> DataFrame:
    """Per cluster: size, mean vector and sum of squared lengths, aggregated as vectors inside the JVM."""
    points = rows.select("cluster_id", array_to_vector("embedding").alias("features"))
    stats = Summarizer.metrics("mean", "count", "normL2").summary(F.col("features"))
    squares = F.aggregate(vector_to_array(F.col("s.normL2")), F.lit(0.0), lambda a, x: a + x * x)
    return points.groupBy("cluster_id").agg(stats.alias("s")).select(
        "cluster_id", F.col("s.count").alias("n"), vector_to_array(F.col("s.mean")).alias("mean"), squares.alias("squares")
    )


def _square(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def calinski_harabasz(labelled: DataFrame) -> DataFrame:
    """Between over within dispersion of unit vectors, from one pass of cluster moments."""
    m = _moments(_unit(labelled))
    total = m.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * _square(F.col("mean"))).alias("centres"), F.sum("squares").alias("squares"),
        Summarizer.mean(array_to_vector("mean"), F.col("n").cast("double")).alias("grand"),
    )
    between = F.col("centres") - F.col("n") * _square(vector_to_array("grand"))
    within = F.col("squares") - F.col("centres")
    # Null for fewer than two clusters, or when no row is off its centre.
    score = F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(within, F.col("n") - F.col("k")))
    return total.select(score.alias("calinski_harabasz"))


def davies_bouldin(labelled: DataFrame) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / centre distance.

    Two passes over the vectors with per-cluster partial aggregates. The centres, one
    row per cluster, are counted and written before they are joined, so that a large
    cluster is no hot key; then they travel as one array to each other.
    """
    rows = _unit(labelled)
    centres = written_once(_moments(rows).select("cluster_id", "mean"))
    near = small(centres, centres.count())
    gap = F.sqrt(_square(F.zip_with("embedding", "mean", lambda a, b: a - b)))
    spread = rows.join(near, "cluster_id").groupBy("cluster_id").agg(F.avg(gap).alias("spread"))
    both = F.collect_list(F.struct("cluster_id", "spread", "mean")).alias("all")
    table = spread.join(centres, "cluster_id").agg(both)
    distance = lambda x, y: F.sqrt(_square(F.zip_with(x["mean"], y["mean"], lambda a, b: a - b)))
    apart = lambda x: F.transform(F.filter("all", lambda y: y["cluster_id"] != x["cluster_id"]),
                                  lambda y: F.coalesce(F.try_divide(x["spread"] + y["spread"], distance(x, y)), F.lit(float("inf"))))
    worst = table.select(F.explode("all").alias("x"), "all").select(F.array_max(apart(F.col("x"))).alias("worst"))
    return worst.agg(F.avg("worst").alias("davies_bouldin"))


def compare_k_values(v: DataFrame, ks: Sequence[int] = (20, 30, 40, 50, 75), seed: int = 42, n_init: int = 10, max_iter: int = 20) -> DataFrame:
    """Four scores of k-means for each k, over all rows. The fits of all ks share their rounds."""
    points = _points(v, F.lit(""))
    _enough(points, max(ks))
    fits = grouped_kmeans(points, {"": list(ks)}, seed, n_init, max_iter)
    vectors = points.select("message_id", F.col("features").alias("embedding"))
    labels = written_once(_labels(points, fits))
    rows = []
    for k in ks:
        labelled = vectors.join(labels.filter(F.col("k") == k).select("message_id", "cluster_id"), "message_id").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            scores = silhouette(labelled).first()[0], calinski_harabasz(labelled).first()[0], davies_bouldin(labelled).first()[0]
        finally:
            labelled.unpersist()
        rows.append((k, *scores, fits["", k].cost))
    return v.sparkSession.createDataFrame(
        rows, "k int, silhouette double, calinski_harabasz double, davies_bouldin double, inertia double"
    )


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    """Rows per cluster, noise left out."""
    return labelled.filter(F.col("cluster_id") != -1).groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy("cluster_id")


def cluster_totals(labelled: DataFrame) -> DataFrame:
    """Number of clusters, noise rows and rows."""
    return labelled.groupBy("cluster_id").agg(F.count("*").alias("n")).agg(
        F.count_if(F.col("cluster_id") != -1).alias("n_clusters"),
        F.sum(F.when(F.col("cluster_id") == -1, F.col("n")).otherwise(0)).alias("n_noise"),
        F.sum("n").alias("n_samples"),
    )


def _preview(chars: int) -> Column:
    return F.substring("content", 1, chars).alias("preview")


def cluster_samples(labelled: DataFrame, messages: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """Up to n members per cluster in a repeatable random order, with the cluster size, platform and source."""
    rows = labelled.filter(F.col("cluster_id") != -1).select("cluster_id", F.col("message_id").alias("id"))
    sizes = rows.groupBy("cluster_id").agg(F.count("*").alias("size"))
    picked = first_per(rows, ["cluster_id"], [F.md5(F.concat("id", F.lit(str(seed)))), F.asc("id")], n)
    return messages.select("id", "platform", "source", _preview(200)).join(picked, "id").join(sizes, "cluster_id").select(
        "cluster_id", "size", "rank", "id", "platform", "source", "preview"
    )


def noise_report(labelled: DataFrame, messages: DataFrame, n: int = 10) -> DataFrame:
    """Clustered and noise rows with their share and newest samples."""
    side = F.when(F.col("cluster_id") == -1, "noise").otherwise("clustered").alias("side")
    rows = labelled.select(F.col("message_id").alias("id"), side)
    counts = rows.groupBy("side").agg(F.count("*").alias("n"))
    everything = labelled.agg(F.count("*")).scalar()
    timed = messages.select("id", "timestamp").join(rows, "id")
    picked = small(first_per(timed, ["side"], newest_first(), n).select("id", "side", "rank"), 2 * n)
    samples = messages.select("id", _preview(200)).join(picked, "id").select("side", "rank", "id", "preview")
    return counts.join(samples, "side").select("side", "n", pct(F.col("n"), everything).alias("pct"), "rank", "id", "preview")


def cluster_members(labelled: DataFrame, messages: DataFrame, chars: int = 200) -> DataFrame:
    """Every clustered message with its preview, one row each."""
    rows = labelled.filter(F.col("cluster_id") != -1).select("cluster_id", F.col("message_id").alias("id"))
    return messages.select("id", _preview(chars)).join(rows, "id").select("cluster_id", "id", "preview")


def cluster_within_category(v: DataFrame, message_taxonomy: DataFrame, categories: Sequence[str], k: int = 10, seed: int = 42,
                            n_init: int = 3, max_iter: int = 20) -> DataFrame:
    """Finer topics: the members of each category clustered on their own, as (message_id, category, k, cluster_id).

    ``k`` is the number of clusters used: a category with fewer distinct vectors gets as many, one with a single
    vector a single cluster. The vectors are joined with their categories once, and all categories share their rounds:
    the number of jobs does not depend on the number of categories.
    """
    wanted = message_taxonomy.filter(F.col("category").isin(list(categories))).select("message_id", "category").distinct()
    points = _points(v.select("message_id", "embedding").join(wanted, "message_id"), F.col("category"))
    used = {category: min(k, n) for category, n in _distinct_vectors(points).items()}
    fits = grouped_kmeans(points, {category: [n] for category, n in used.items()}, seed, n_init, max_iter)
    return _labels(points, fits).select("message_id", F.col("group").alias("category"), "k", "cluster_id")
