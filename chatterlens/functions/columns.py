"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A broadcast hint is given only to frames whose row count is fixed by a parameter.
MAX_BROADCAST_ROWS = 10_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: str | Column) -> Column:
    """Remove leading and trailing white space of every kind, not only spaces."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def ratio(n: Column, d: Column, digits: int = 1) -> Column:
    """n / d for non-negative integers, rounded half up in integer arithmetic."""
    n, d = n.cast("bigint"), d.cast("bigint")
    scale = 10**digits
    return F.when(d > 0, F.floor((n * (2 * scale) + d) / (d * 2)) / F.lit(float(scale)))


def pct(n: Column, d: Column, digits: int = 1) -> Column:
    """n as a percentage of d, rounded half up."""
    return ratio(n * 100, d, digits)


def utc_timestamp(epoch_seconds: str | Column) -> Column:
    """Epoch seconds as a zone-free UTC timestamp."""
    return F.timestamp_add("SECOND", col(epoch_seconds), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def epoch_seconds(ts_ntz: str | Column) -> Column:
    """A zone-free UTC timestamp as whole epoch seconds."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(ts_ntz))


def word_array(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def explode_once(array: Column, name: str) -> tuple[Column, Column]:
    """An explode, and the filter to apply to its result, that compute the array once.

    A plain explode lets the optimizer infer a size filter, which it pushes below
    the projection and so evaluates the array twice.
    """
    return F.explode_outer(array).alias(name), F.col(name).isNotNull()


def name_bit(c: str | Column, names: Sequence[str]) -> Column:
    """A long with one bit for the place of a name in a short list; ``bit_or`` of it is a set of names.

    Unlike ``collect_set`` this aggregates in a fixed-width hash buffer, without sorting rows.
    """
    if len(names) > 62:
        raise ValueError("at most 62 names fit")
    bits = F.lit(0).cast("bigint")
    for place, name in enumerate(names):
        bits = F.when(col(c) == name, F.lit(1 << place).cast("bigint")).otherwise(bits)
    return bits


def names_in_bits(bits: str | Column, names: Sequence[str]) -> Column:
    """The sorted names of a bit set built with ``name_bit``."""
    present = [F.when(col(bits).bitwiseAND(F.lit(1 << names.index(n))) != 0, F.lit(n)) for n in sorted(names)]
    return F.array_compact(F.array(*present))


def newest_first(ts: str = "timestamp", key: str = "id") -> list[Column]:
    """The order used wherever the source order is undefined."""
    return [F.desc(ts), F.asc(key)]


def top(df: DataFrame, k: int | None, *order: Column) -> DataFrame:
    """Ordered first k rows, or all rows in order when k is None."""
    df = df.orderBy(*order)
    return df if k is None else df.limit(k)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast for a frame known to hold at most ``max_rows`` rows."""
    return F.broadcast(df) if max_rows <= MAX_BROADCAST_ROWS else df


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each key; n bounds what is kept, also before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def ordered_list(rank: str, value: str | Column) -> Column:
    """Aggregate: values in rank order. Use only after the group size was bounded."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), col(value).alias("v"))))
    return F.transform(pairs, lambda p: p["v"])
