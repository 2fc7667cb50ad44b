"""Exact search over message vectors; ``ivf`` has the approximate one.

Distance is squared Euclidean; ties rank by message id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlens.functions.columns import first_per, small
from chatterlens.operators.ingest import first_by_key

META = ["platform", "source", "timestamp", "author_id", "content_preview"]
SLICE_ROWS = 2048


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow list column as a (rows, dims) float64 matrix, without touching single rows in Python."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    if flat.size != len(column) * dims:
        raise ValueError(f"vectors must have {dims} dimensions")
    return flat.reshape(len(column), dims)


def _nearest(vectors: DataFrame, queries: Mapping[str, Sequence[float]], k: int) -> DataFrame:
    """(query_id, message_id, distance): each task keeps its k best per query, then they are merged."""
    names = list(queries)
    points = np.asarray([queries[n] for n in names], dtype="float64")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: (np.empty(0), np.empty(0, dtype=object)) for n in names}
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                rows = matrix(part.column(1), points.shape[1])
                for name, point in zip(names, points):
                    distance = ((rows - point) ** 2).sum(axis=1)
                    distance = np.concatenate([best[name][0], distance])
                    keys = np.concatenate([best[name][1], ids])
                    if len(distance) > k:
                        bound = np.partition(distance, k - 1)[k - 1]
                        keep = distance <= bound
                        distance, keys = distance[keep], keys[keep]
                    order = np.lexsort((keys.astype(str), distance))[:k]
                    best[name] = (distance[order], keys[order])
        for name in names:
            distance, keys = best[name]
            yield pa.RecordBatch.from_pydict({
                "query_id": pa.array([name] * len(keys), pa.string()),
                "message_id": pa.array(keys, pa.string()),
                "distance": pa.array(distance, pa.float64()),
            })

    local = vectors.select("message_id", "embedding").mapInArrow(scan, "query_id string, message_id string, distance double")
    return first_per(local, ["query_id"], [F.asc("distance"), F.asc("message_id")], k)


def vector_search(vectors: DataFrame, queries: Mapping[str, Sequence[float]], k: int = 10,
                  where: Column | None = None) -> DataFrame:
    """The k nearest vectors to each query vector, with their metadata.

    Filters apply before the distance. Only ids and distances leave the scan;
    metadata is joined to the k rows kept per query.
    """
    if k < 1 or not queries:
        raise ValueError("give at least one query and k >= 1")
    found = vectors if where is None else vectors.filter(where)
    keys = small(_nearest(found, queries, k), k * len(queries))
    meta = [c for c in META if c in vectors.columns]
    return (
        vectors.select("message_id", *meta).join(keys, "message_id")
        .select("query_id", "rank", "message_id", "distance", *meta).orderBy("query_id", "rank")
    )


def stored_vector(vectors: DataFrame, message_id: str) -> list[float]:
    """One stored vector; raises when the id is absent."""
    row = vectors.filter(F.col("message_id") == message_id).select("embedding").first()
    if row is None:
        raise KeyError(f"no vector for {message_id}")
    return list(row["embedding"])


def similar_to_message(vectors: DataFrame, message_id: str, k: int = 10, where: Column | None = None) -> DataFrame:
    """The k nearest vectors to a stored one, itself left out."""
    others = F.col("message_id") != message_id
    return vector_search(
        vectors, {message_id: stored_vector(vectors, message_id)}, k, others if where is None else others & where
    )


def search_by_platform(vectors: DataFrame, queries: Mapping[str, Sequence[float]], platform: str, k: int = 10) -> DataFrame:
    return vector_search(vectors, queries, k, F.col("platform") == platform)


def search_by_timerange(vectors: DataFrame, queries: Mapping[str, Sequence[float]], start: int, end: int, k: int = 10) -> DataFrame:
    return vector_search(vectors, queries, k, F.col("timestamp").between(start, end))


def search_filtered(vectors: DataFrame, queries: Mapping[str, Sequence[float]], where: Column,
                    contains: str | None = None, k: int = 10) -> DataFrame:
    """Search among rows that satisfy a predicate and whose preview contains a text."""
    if contains is not None:
        where = where & F.contains("content_preview", F.lit(contains))
    return vector_search(vectors, queries, k, where)


def search_text(vectors: DataFrame, texts: Mapping[str, str], provider: Callable[[list[str]], list[list[float]]], k: int = 10,
                where: Column | None = None) -> DataFrame:
    """The k nearest vectors to each query text, which the provider embeds as it did the stored ones."""
    names = list(texts)
    return vector_search(vectors, dict(zip(names, provider([texts[n] for n in names]))), k, where)


def add_vectors(vectors: DataFrame, incoming: DataFrame, dim: int) -> DataFrame:
    """All vectors after adding those with a new id; a wrong length raises when the plan runs."""
    checked = incoming.withColumn(
        "embedding",
        F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(
            F.raise_error(F.concat(F.lit("wrong vector length for "), F.col("message_id"))).cast("array<float>")
        ),
    )
    order = F.struct(*[F.col(c) for c in incoming.columns if c not in ("message_id",)])
    fresh = first_by_key(checked, "message_id", order).join(vectors.select("message_id"), "message_id", "left_anti")
    return vectors.unionByName(fresh.select(*incoming.columns), allowMissingColumns=True)


def vector_exists(vectors: DataFrame, message_id: str) -> DataFrame:
    return vectors.filter(F.col("message_id") == message_id).agg((F.count("*") > 0).alias("exists"))


def missing_vector_ids(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("id").join(vectors.select(F.col("message_id").alias("id")), "id", "left_anti")


def delete_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """All vectors but those of the ids; write the result to a new folder and swap."""
    return vectors.join(ids.select(F.col("id").alias("message_id")), "message_id", "left_anti").select(*vectors.columns)


def reset_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.limit(0)


def vector_stats(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims"))
