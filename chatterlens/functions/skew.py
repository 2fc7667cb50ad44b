"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more left rows than this is spread over several tasks.
HOT_ROWS = 1_000_000


def spread_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str], spread_by: str, how: str = "inner",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """An equi-join whose hot left keys are split over several tasks.

    Keys with more than ``hot_rows`` left rows get one slice per ``hot_rows`` rows:
    their left rows are dealt out by a hash of ``spread_by``, their right rows are
    repeated per slice. Few keys can be hot; adaptive execution broadcasts their list where
    its measured size allows it. Adaptive skew handling does the same only where both join
    inputs are plain shuffles; use this where one side is an aggregate or is
    already partitioned by the key.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    hot = (
        left.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > hot_rows)
        .select(*keys, F.ceil(F.col("__n") / hot_rows).alias("__slices"))
    )
    slices = F.coalesce("__slices", F.lit(1))
    dealt = left.join(hot, keys, "left").withColumn("__slice", F.pmod(F.xxhash64(spread_by), slices))
    repeated = right.join(hot, keys, "left").withColumn("__slice", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1)))
    return dealt.drop("__slices").join(repeated.drop("__slices"), [*keys, "__slice"], how).drop("__slice")
