"""Report tables over categorised messages with author and keywords.

Inputs: ``msgs`` from ``integration_messages``, ``kw`` from ``keyword_messages``,
``cross`` from ``cross_category_keywords``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterlens.functions import fixed_values as fv
from chatterlens.functions.columns import explode_once, first_per, name_bit, names_in_bits, newest_first, ordered_list, pct, small, top
from chatterlens.operators.enrich import auto_categories, extract_keywords, extract_tools_and_pains, with_themes
from chatterlens.operators.tables import messages_with_author_by_category
from chatterlens.session import written_once
from chatterlens.sources.corpus import Corpus


def integration_messages(g: Corpus, categories: Sequence[str] = ("integration_requests",),
                         vocab: Sequence[str] = tuple(fv.INTEGRATION_WORDS), content: bool = False) -> DataFrame:
    """Messages with author, keywords and automatic labels; with their text only on request.

    Words are found before the joins, where the text is read, so texts are not shuffled.
    """
    found = auto_categories(extract_keywords(
        g.messages.select("id", "content", "platform", "timestamp", "source", "author_id"), vocab
    ))
    return messages_with_author_by_category(g, list(categories), found if content else found.drop("content"))


def keyword_messages(g: Corpus, categories: Sequence[str] = fv.REPORT_CATEGORIES) -> DataFrame:
    """Messages of the actionable categories with author, tools and pains, without their text."""
    found = extract_tools_and_pains(g.messages.select("id", "content", "platform", "timestamp", "source", "author_id"))
    return messages_with_author_by_category(g, list(categories), found.drop("content"))


def _top_entries(msgs: DataFrame, column: str, name: str, k: int) -> DataFrame:
    """The most frequent array entries and their share of all rows.

    Every row also counts one empty entry, so the number of rows comes from the same pass.
    """
    entry, _ = explode_once(F.concat(F.col(column), F.array(F.lit(""))), name)
    counts = msgs.select(entry).groupBy(name).agg(F.count("*").alias("n"))
    everything = counts.filter(F.col(name) == "").select("n").scalar()
    ranked = top(counts.filter(F.col(name) != ""), k, F.desc("n"), F.asc(name))
    return ranked.withColumn("pct", pct(F.col("n"), everything))


def report_platform_distribution(msgs: DataFrame) -> DataFrame:
    counts = msgs.groupBy("platform").agg(F.count("*").alias("n"))
    everything = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", pct(F.col("n"), everything)).orderBy(F.desc("n"), "platform")


def report_top_keywords(msgs: DataFrame, k: int = 30) -> DataFrame:
    return _top_entries(msgs, "keywords", "keyword", k)


def report_auto_category_counts(msgs: DataFrame, k: int = 10) -> DataFrame:
    return _top_entries(msgs, "auto_categories", "auto_category", k)


def report_messages_per_category(msgs: DataFrame, messages: DataFrame, n: int = 50,
                                 labels: int = len(fv.AUTO_KEYWORD_CUES) + len(fv.AUTO_TEXT_CUES) + 1) -> DataFrame:
    """Newest messages of each automatic label, with the label's total and how many are left out.

    Rows are picked without texts; the texts of the few picked are joined last.
    """
    label, _ = explode_once(F.col("auto_categories"), "auto_category")
    rows = written_once(msgs.select("id", "timestamp", "platform", "username", label))
    totals = rows.groupBy("auto_category").agg(F.count("*").alias("total"))
    picked = first_per(rows, ["auto_category"], newest_first(), n).join(totals, "auto_category").drop("timestamp")
    return messages.select("id", "content").join(small(picked, n * labels), "id").select(
        "auto_category", "rank", F.col("content").alias("message"), "platform", "username", "total",
        F.greatest(F.col("total") - n, F.lit(0)).alias("more"),
    )


def report_top_requesters(msgs: DataFrame, k: int = 10) -> DataFrame:
    return top(msgs.groupBy("username").agg(F.count("*").alias("n")), k, F.desc("n"), F.asc("username"))


def report_insights(msgs: DataFrame) -> DataFrame:
    """Counters of the summary, from one pass."""
    counters = {
        "migration_export": F.array_contains("auto_categories", "migration_export"),
        "supabase": F.array_contains("keywords", "supabase"),
        "stripe": F.array_contains("keywords", "stripe"),
        "discord": F.col("platform") == "discord",
        "reddit": F.col("platform") == "reddit",
    }
    sums = msgs.agg(*[F.count_if(test).alias(name) for name, test in counters.items()])
    pairs = [c for name in counters for c in (F.lit(name), F.col(name))]
    return sums.select(F.stack(F.lit(len(counters)), *pairs).alias("metric", "n"))


def report_category_distribution(g: Corpus, categories: Sequence[str] = fv.REPORT_CATEGORIES) -> DataFrame:
    """Message rows per actionable category; counted per author before the user join."""
    labels = g.message_taxonomy.filter(F.col("category").isin(list(categories))).select(F.col("message_id").alias("id"), "category")
    per_user = g.messages.select("id", "author_id").join(labels, "id").groupBy("category", "author_id").agg(F.count("*").alias("n"))
    counts = per_user.join(g.authors(), "author_id", "left_semi").groupBy("category").agg(F.sum("n").alias("n"))
    everything = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", pct(F.col("n"), everything)).orderBy(F.desc("n"), "category")


def report_top_themes(kw: DataFrame, k: int = 15, keywords: int = 10, themes: Mapping[str, Sequence[str]] = fv.THEMES) -> DataFrame:
    """The largest themes with their most frequent keywords, both from one aggregate of (theme, user or keyword)."""
    rows = with_themes(kw.select("username", "category", "all"), themes)
    names = list(fv.TAXONOMY)
    entries = F.concat(
        F.array(F.struct(F.lit("user").alias("kind"), F.col("username").alias("value"))),
        F.transform(F.array_distinct("all"), lambda w: F.struct(F.lit("word").alias("kind"), w.alias("value"))),
    )
    entry, _ = explode_once(entries, "entry")
    counts = written_once(
        rows.select("theme", name_bit("category", names).alias("bit"), entry).groupBy("theme", "entry.kind", "entry.value")
        .agg(F.count("*").alias("n"), F.bit_or("bit").alias("bits"))
    )
    sums = counts.filter("kind = 'user'").groupBy("theme").agg(
        F.sum("n").alias("messages"), F.count("*").alias("users"), F.bit_or("bits").alias("bits")
    ).select("theme", "messages", "users", names_in_bits("bits", names).alias("categories"))
    ranked = first_per(counts.filter("kind = 'word'").withColumnRenamed("value", "keyword"), ["theme"], [F.desc("n"), F.asc("keyword")], keywords)
    words = ranked.groupBy("theme").agg(ordered_list("rank", "keyword").alias("keywords"))
    return top(sums, k, F.desc("messages"), F.asc("theme")).join(words, "theme").orderBy(F.desc("messages"), "theme")


def report_cross_patterns(cross: DataFrame, k: int | None = 20) -> DataFrame:
    """The most mentioned cross-category keywords; all of them when k is None."""
    return top(cross, k, F.desc("total_mentions"), F.asc("keyword"))


def report_theme_samples(kw: DataFrame, messages: DataFrame, min_messages: int = 10, n: int = 20, chars: int = 500,
                         themes: Mapping[str, Sequence[str]] = fv.THEMES) -> DataFrame:
    """Newest messages of each theme that is large enough; texts are joined to the few rows picked."""
    rows = with_themes(kw.select("id", "timestamp", "category", "platform", "username", "tools", "all"), themes)
    rows = written_once(rows.drop("all"))
    totals = rows.groupBy("theme").agg(F.count("*").alias("total")).filter(F.col("total") >= min_messages)
    picked = first_per(rows, ["theme"], [*newest_first(), F.asc("category")], n).join(small(totals, len(themes)), "theme")
    return messages.select("id", "content").join(small(picked, n * len(themes)), "id").select(
        "theme", "rank", "category", "platform", "username", "tools", F.substring("content", 1, chars).alias("message"), "total"
    )


def report_migration_mentions(cross: DataFrame, words: Sequence[str] = ("migrate", "export")) -> DataFrame:
    """Mentions of migration words, each only when it spans enough categories."""
    return cross.filter(F.col("keyword").isin(list(words))).agg(F.coalesce(F.sum("total_mentions"), F.lit(0)).alias("n"))
