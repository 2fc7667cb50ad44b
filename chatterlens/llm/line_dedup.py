"""Cross-site line deduplication by the number of distinct sites on which a line stands.

Every line (trimmed, not blank) has a HyperLogLog sketch of the sites of its documents; sketches of one line merge by
aggregation, first per task, then per line hash, so a line that stands in every document costs one sketch per task.
Lines whose estimate lies near the threshold get an exact count of distinct sites. Lines on at least ``min_sites`` sites
are boilerplate: they stay in the document with the smallest id that holds them and go from all others.

Defined results: a null text stays null and has no lines; null sites count as one site of their own; blank lines stay;
lines that differ in surrounding white space only are one line; equal rows lose the same lines, and rows with one id
but different texts are treated each by their own text; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlens.llm.base import fresh_name, small_batches, written

SPACES = " \t\n\x0b\f\r"
LOG_REGISTERS = 12
#: Estimates within this many standard errors of the threshold (at least one site) are counted exactly.
ERRORS = 5.0


def line_hashes(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, site, text_key, pos, line) per line with something on it; lines and sites as 64-bit hashes."""
    hashes = F.transform(F.split(F.col(text_col), "\n"), lambda x: F.when(F.btrim(x, F.lit(SPACES)) != "", F.xxhash64(F.btrim(x, F.lit(SPACES)))))
    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(site_col).cast("string")).alias("site"), F.xxhash64(F.col(text_col)).alias("text_key"),
        F.posexplode(hashes).alias("pos", "line"),
    ).filter("line IS NOT NULL")


def widespread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """(line, first) of the lines on at least ``min_sites`` sites; ``first`` is the smallest id that holds the line."""
    margin = max(1.0, ERRORS * 1.04 / math.sqrt(1 << LOG_REGISTERS) * min_sites)
    spread = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("sites"), F.min("id").alias("first")
    ).filter(F.col("sites") >= min_sites - margin)
    spread = written(spread, "line-spread")
    near = spread.filter(F.col("sites") <= min_sites + margin).select("line")
    exact = lines.join(near, "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count("*").alias("exact"))
    return spread.join(exact, "line", "left").filter(F.coalesce("exact", "sites") >= min_sites).select("line", "first")


def without_widespread_lines(
    docs: DataFrame, min_sites: int = 8, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source"
) -> DataFrame:
    """The documents with cross-site boilerplate removed, and ``n_lines_removed``, which replaces a column of that name."""
    small_batches(docs.sparkSession)
    docs = docs.drop("n_lines_removed")
    drop_id, drop_key, dropped = (fresh_name(docs, name) for name in ("drop_id", "drop_key", "drop"))
    lines = line_hashes(docs, id_col, text_col, site_col)
    common = written(widespread_lines(lines, min_sites), "lines")
    drop = (
        lines.join(common, "line").filter(~F.col("id").eqNullSafe(F.col("first")))
        .groupBy(F.col("id").alias(drop_id), F.col("text_key").alias(drop_key)).agg(F.collect_set("pos").alias(dropped))
    )

    @F.pandas_udf("string")
    def cut(texts: pd.Series, drops: pd.Series) -> pd.Series:
        made = []
        for text, drop in zip(texts, drops):
            if text is not None and drop is not None:
                gone = set(drop)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            made.append(text)
        return pd.Series(made, dtype=object)

    keys = F.col(f"d.{id_col}").eqNullSafe(F.col(drop_id)) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col(drop_key))
    joined = docs.alias("d").join(drop, keys, "left")
    columns = [cut(F.col(f"d.{text_col}"), F.col(dropped)).alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias("n_lines_removed"))
