"""Quality rules: base rules on words, then robust multivariate outliers per language and source.

DataFrame functions only. The texts are read once, into a small table of counts. Each stratum (language and source;
strata with fewer than ``min_group`` documents are pooled per language, those languages' rest into one) gets a
minimum-covariance-determinant estimate of four statistics, logarithms that vary in ordinary documents too: mean word
length, share of characters that are no letters, words per line and share of distinct words. Every stratum has two
starts, the absolute deviations around the medians and the covariance of values drawn in to two deviations. A
concentration step takes the ``support`` share of the stratum's vectors with the smallest distances and their mean and
covariance; a fit steps until its determinant stops falling, and the start with the smaller determinant is kept. Equal
vectors of a stratum count once, so that many copies of a text don't make the other documents outliers. A document
goes if its squared Mahalanobis distance exceeds ``cutoff``, to whichever side of the centre it lies.

All strata and both starts take part in the same aggregations (partial sums per task), so a source with a third of all
rows is no bottleneck. The estimates are counted: up to ``FEW`` they are broadcast, beyond that they are joined with
the rows of large strata dealt over several tasks.

Defined results: a null text has no words and fails the base rules; null languages and sources form strata of their own;
repeated rows are judged alike; a statistic without spread in a stratum gets a hundredth of its spread in the whole table;
documents of strata with fewer than ``LEAST_VECTORS`` different vectors have no ``d2`` and stay; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlens.functions.skew import spread_join
from chatterlens.llm.base import row_key, written

SPACES = " \t\n\x0b\f\r"
WORD_BREAK = r"[ \t\n\x0B\f\r]+"
SYMBOLS = r"[#*$%&|<>]"
LETTERS = r"[\p{L}\p{M}]+"
WINDOW = 8
STATISTICS = ("z_length", "z_other", "z_lines", "z_distinct")
D = len(STATISTICS)
#: Least standard deviation of a statistic in a stratum, as a share of its deviation over all documents.
LEAST_SPREAD = 0.01
#: Fits stop once a step lowers the logarithm of the determinant by less than this.
LEAST_FALL = 1e-3
#: A stratum with fewer different vectors has no estimate: its documents stay, if they pass the base rules.
LEAST_VECTORS = 5 * D
#: Estimates (a few hundred bytes each) up to this number are broadcast.
FEW = 10_000
#: Share of a normal sample that the default cutoff keeps; texts have heavier tails than that.
KEPT_SHARE = 1 - 1e-8


def window_hashes(words: Column) -> Column:
    """The hash of every window of eight words."""
    return F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))


def repeated_words(frame: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in windows that occur twice or more in ``words``, the first occurrence included.

    Only texts with a repeated window sort their windows. Each array is a column of its own, so that no lambda
    computes it again for every element.
    """
    frame = frame.withColumn("hashes", window_hashes(F.col("words")))
    frame = frame.withColumn("ordered", F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))
    frame = frame.withColumn("marked", F.transform("ordered", lambda x, k: F.when(
        (F.get("ordered", k - 1)["h"] == x["h"]) | (F.get("ordered", k + 1)["h"] == x["h"]), x["i"])))
    frame = frame.withColumn("places", F.array_sort(F.filter("marked", lambda i: i.isNotNull())))
    # Places in order: each adds the words up to the next one, at most a window.
    frame = frame.withColumn("spans", F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW)))))
    covered = F.aggregate("spans", F.lit(0), lambda total, x: total + x)
    return frame.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The base counts of every whole text, its id and the columns of ``keep``; no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(
        F.col(id_col).alias("id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], text.alias("text"),
        F.filter(F.split(text, WORD_BREAK), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("lines"),
    )
    second = first.select(
        "id", *[f"k{i}" for i in range(len(keep))], "words", F.array_join("words", "").alias("joined"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    return repeated_words(second).select(
        F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        F.size("words").cast("long").alias("n_words"),
        F.length("joined").cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        F.length(F.regexp_replace("joined", LETTERS, "")).cast("long").alias("n_other"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def statistics() -> list[Column]:
    """Logarithms of the mean word length, the share of other characters than letters, the words per line and the share
    of distinct words. The constants stand for 20 different words of five characters, and for 100 characters with
    five others: they keep short texts, whose shares scatter most, near the others."""
    return [
        F.log((F.col("word_chars") + 100) / (F.col("n_words") + 20)),
        F.log((F.col("n_other") + 5) / (F.col("word_chars") + 100)),
        F.log(F.greatest(F.col("n_words"), F.lit(1)) / F.greatest(F.col("n_lines"), F.lit(1))),
        F.log((F.col("n_distinct") + 20) / (F.col("n_words") + 20)),
    ]


def chi2_cdf(x: float, d: int) -> float:
    """For even d."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return low


#: The default cutoff on the squared distance.
CUTOFF = chi2_quantile(KEPT_SHARE, D)


def consistency(support: float) -> float:
    """What makes the covariance of the central part of a normal sample unbiased."""
    return support / chi2_cdf(chi2_quantile(support, D), D + 2)


def _cell(i: int, j: int) -> str:
    return f"l{i}{j}"


MEANS = [f"m{i}" for i in range(D)]
CELLS = [_cell(i, j) for i in range(D) for j in range(i + 1)]
FIT = ["stratum", "start"]


def least_spreads(features: DataFrame) -> list[float]:
    """The least variance of each statistic: one row of sums over all documents."""
    pooled = features.agg(*[F.var_pop(s) for s in STATISTICS]).first()
    return [LEAST_SPREAD**2 * (v or 0.0) + 1e-12 for v in pooled]


def cholesky(frame: DataFrame, factor: float, least: list[float]) -> DataFrame:
    """Centre, lower triangle of the covariance (scaled by ``factor``, least variances added) and ``log_det`` of every fit."""
    for i in range(D):
        for j in range(i + 1):
            rest = F.lit(0.0)
            for k in range(j):
                rest = rest + F.col(_cell(i, k)) * F.col(_cell(j, k))
            value = factor * F.col(f"c{i}{j}") + (least[i] if i == j else 0.0) - rest
            frame = frame.withColumn(_cell(i, j), F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(_cell(j, j)))
    log_det = sum((2 * F.log(_cell(i, i)) for i in range(1, D)), 2 * F.log(_cell(0, 0)))
    return frame.select(*FIT, *MEANS, *CELLS, log_det.alias("log_det"))


def distance() -> tuple[list[Column], list[str]]:
    """Steps of the forward substitution as (columns, names): y0 .. y3, whose squares add up to the distance."""
    steps = []
    for i in range(D):
        value = F.col(STATISTICS[i]) - F.col(f"m{i}")
        for k in range(i):
            value = value - F.col(_cell(i, k)) * F.col(f"y{k}")
        steps.append(value / F.col(_cell(i, i)))
    return steps, [f"y{i}" for i in range(D)]


def attached(rows: DataFrame, small: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """The rows with what ``small`` holds for their keys; few estimates are broadcast, for many a hot stratum is split."""
    return rows.join(F.broadcast(small), keys) if few else spread_join(rows, small, keys, "q_id")


def measured(features: DataFrame, estimates: DataFrame, few: bool = True) -> DataFrame:
    """Features with ``d2``, the squared Mahalanobis distance to the centre of each of their stratum's fits (``start``)."""
    frame = attached(features, estimates.drop("log_det"), ["stratum"], few)
    steps, names = distance()
    for step, name in zip(steps, names):
        frame = frame.withColumn(name, step)
    return frame.withColumn("d2", sum((F.col(y) ** 2 for y in names[1:]), F.col(names[0]) ** 2)).drop(*MEANS, *CELLS, *names)


def moments(rows: DataFrame, of: list[str]) -> DataFrame:
    """Mean and covariance of the columns ``of`` per fit."""
    means = [F.avg(s).alias(f"m{i}") for i, s in enumerate(of)]
    cross = [F.covar_pop(of[i], of[j]).alias(f"c{i}{j}") for i in range(D) for j in range(i + 1)]
    return rows.groupBy(*FIT).agg(*means, *cross)


def starts(features: DataFrame, least: list[float], few: bool) -> DataFrame:
    """Both starts of every stratum: squared absolute deviations, and the covariance of values drawn in, around the medians."""
    middle = written(features.groupBy("stratum").agg(*[F.percentile_approx(s, 0.5, 1000).alias(f"m{i}") for i, s in enumerate(STATISTICS)]), "middle")
    away = attached(features, middle, ["stratum"], few)
    spread = written(away.groupBy("stratum", *MEANS).agg(
        *[(1.4826 * F.percentile_approx(F.abs(F.col(s) - F.col(f"m{i}")), 0.5, 1000)).alias(f"s{i}") for i, s in enumerate(STATISTICS)]), "spread")
    plain = spread.select("stratum", F.lit(0).alias("start"), *MEANS, *[
        (F.pow(f"s{i}", F.lit(2)) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(D) for j in range(i + 1)])
    near = attached(features, spread, ["stratum"], few).withColumns({
        s: F.greatest(F.least(F.col(s), F.col(f"m{i}") + 2 * F.col(f"s{i}")), F.col(f"m{i}") - 2 * F.col(f"s{i}")) for i, s in enumerate(STATISTICS)})
    drawn = moments(near.drop(*MEANS).withColumn("start", F.lit(1)), list(STATISTICS))
    return written(cholesky(plain.unionByName(drawn), 1.0, least), "starts")


def concentrate(features: DataFrame, support: float, steps: int, few: bool = True) -> DataFrame:
    """The minimum-covariance-determinant estimate of every stratum, from ``features`` (q_id, stratum, the statistics).

    All fits that still move take a step together; ``steps`` only bounds the number of rounds.
    """
    least = least_spreads(features)
    moving, settled = starts(features, least, few).withColumn("log_det", F.lit(float("inf"))), []
    for _ in range(steps):
        near = measured(features, moving, few)
        # One row per fit; written, so that each step starts from a short plan.
        bound = written(near.groupBy(*FIT).agg(F.percentile_approx("d2", support, 1000).alias("bound")), "bound")
        made = cholesky(moments(attached(near, bound, FIT, few).filter("d2 <= bound"), list(STATISTICS)), consistency(support), least)
        before = moving.select(*FIT, F.col("log_det").alias("before"))
        made = written(made.join(before, FIT).withColumn("fell", F.col("before") - F.col("log_det") > LEAST_FALL), "fits")
        settled.append(made.filter("NOT fell"))
        moving = made.filter("fell").drop("before", "fell")
        if moving.isEmpty():
            break
    else:
        settled.append(moving.withColumns({"before": F.lit(0.0), "fell": F.lit(True)}))
    fits = settled[0]
    for more in settled[1:]:
        fits = fits.unionByName(more)
    kept = F.min_by(F.struct("start", *MEANS, *CELLS, "log_det"), F.struct("log_det", "start"))
    return written(fits.groupBy("stratum").agg(kept.alias("f")).select("stratum", "f.*"), "mcd")


def quality(
    docs: DataFrame, support: float = 0.75, steps: int = 100, cutoff: float = CUTOFF, min_group: int = 50,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """Counts, ``base_failed``, the squared distance ``d2`` and ``kept`` for every document.

    ``row_key``, a hash of text, language and source, tells rows apart that share an id.
    """
    named = docs.select(
        F.col(id_col).alias("q_id"), F.col(text_col).alias("q_text"), F.col(lang_col).alias("g_lang"), F.col(source_col).alias("g_source"),
        row_key(text_col, lang_col, source_col).alias("row_key"))
    made = counts(named, "q_id", "q_text", ("g_lang", "g_source", "row_key"))
    made = made.withColumns({"base_failed": base_failed(), **dict(zip(STATISTICS, statistics()))})
    made = written(made, "quality")
    sound = made.filter(~F.col("base_failed"))
    sizes = sound.groupBy("g_lang", "g_source").agg(F.count("*").alias("n"))
    pooled = sizes.groupBy("g_lang").agg(F.sum(F.when(F.col("n") < min_group, F.col("n"))).alias("pool"))
    strata = sizes.alias("s").join(pooled.alias("p"), F.col("s.g_lang").eqNullSafe(F.col("p.g_lang"))).select(
        F.col("s.g_lang").alias("s_lang"), F.col("s.g_source").alias("s_source"),
        F.when(F.col("n") >= min_group, F.xxhash64("s.g_lang", "s.g_source", F.lit("both")))
        .when(F.col("pool") >= min_group, F.xxhash64("s.g_lang", F.lit("language")))
        .otherwise(F.lit(0)).alias("stratum"),
    )
    strata = written(strata, "strata")
    few = strata.count() <= FEW
    listed = F.broadcast(strata) if few else strata
    placed = sound.join(listed, F.col("g_lang").eqNullSafe(F.col("s_lang")) & F.col("g_source").eqNullSafe(F.col("s_source"))).drop("s_lang", "s_source")
    placed = written(placed.select("stratum", *made.columns), "placed")
    # Equal vectors count once: they meet in partial aggregates, however many copies there are.
    features = written(placed.groupBy("stratum", *STATISTICS).agg(F.min("q_id").alias("q_id")), "vectors")
    estimates = concentrate(features, support, steps, few).join(features.groupBy("stratum").agg(F.count("*").alias("n_vectors")), "stratum")
    judged = measured(placed, written(estimates, "estimates"), few).withColumn("d2", F.when(F.col("n_vectors") >= LEAST_VECTORS, F.col("d2")))
    out = [F.col("q_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*out, "d2", F.coalesce(F.col("d2") <= cutoff, F.lit(True)).alias("kept"), "row_key").unionByName(
        made.filter("base_failed").select(*out, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"), "row_key")
    )
