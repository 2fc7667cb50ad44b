"""Exploration queries over the graph frames.

Where the source gives no order, limited results are the newest rows
(timestamp descending, then id), so that they repeat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlens.functions import fixed_values as fv
from chatterlens.functions.columns import first_per, newest_first, pct, small, top, utc_timestamp
from chatterlens.operators.graph import category_nodes
from chatterlens.sources.corpus import Corpus


def categories_by_size(g: Corpus) -> DataFrame:
    return category_nodes(g).orderBy(F.desc("message_count"), "name")


def _edges(g: Corpus, categories: Sequence[str] | None, limit: int | None, with_user: bool) -> DataFrame:
    rows = g.facts(categories, "timestamp")
    if with_user:
        rows = rows.join(g.authors(), "author_id", "left_semi")
    columns = ["category", F.col("id").alias("message_id")] + ([F.col("author_id").alias("user_id")] if with_user else [])
    if limit is None:
        return rows.select(*columns)
    return top(rows, limit, *newest_first(), F.asc("category")).select(*columns)


def category_message_edges(g: Corpus, limit: int = 200) -> DataFrame:
    return _edges(g, None, limit, with_user=False)


def category_neighbourhood(g: Corpus, category: str = "integration_requests", limit: int = 100) -> DataFrame:
    return _edges(g, [category], limit, with_user=True)


def actionable_sample(g: Corpus, categories: Sequence[str] = fv.SAMPLED_CATEGORIES, limit: int = 150) -> DataFrame:
    return _edges(g, categories, limit, with_user=False)


def power_users(g: Corpus, min_messages: int = 20, k: int = 50) -> DataFrame:
    rows = g.users.filter(F.col("message_count") > min_messages)
    return top(rows, k, F.desc("message_count"), F.asc("id")).select("id", "platform", "username", "message_count")


def power_user_messages(g: Corpus, min_messages: int = 30, limit: int = 100) -> DataFrame:
    users = g.authors("message_count").filter(F.col("message_count") > min_messages).select("author_id")
    rows = g.classified_messages("author_id", "timestamp").join(users, "author_id", "left_semi")
    return top(rows, limit, *newest_first()).select(F.col("author_id").alias("user_id"), F.col("id").alias("message_id"))


def most_active_users(g: Corpus, k: int = 20) -> DataFrame:
    return top(g.users, k, F.desc("message_count"), F.asc("id")).select(
        "platform", "username", F.col("message_count").alias("messages")
    )


def messages_per_platform(g: Corpus) -> DataFrame:
    return g.classified_messages("platform").groupBy("platform").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "platform")


def platform_samples(g: Corpus, limit: int = 20, platforms: Sequence[str] = fv.PLATFORMS) -> DataFrame:
    rows = g.classified_messages("platform", "source", "timestamp").filter(F.col("platform").isin(list(platforms)))
    keys = top(rows, limit, *newest_first())
    return g.fetch(keys, limit, "content").select("platform", "content", "source")


def reply_pairs(g: Corpus, limit: int = 50) -> DataFrame:
    return top(g.replies(), limit, F.asc("child_id"), F.asc("parent_id"))


def deep_threads(g: Corpus, max_depth: int = 3, limit: int = 30) -> DataFrame:
    """The first reply paths of 1..max_depth hops, as arrays of ids from reply to ancestor.

    Every reply starts at least one path, so the first ``limit`` replies hold the
    first ``limit`` paths; only those are followed upwards.
    """
    edges = g.replies()
    paths = top(edges, limit, F.asc("child_id")).select(F.array("child_id", "parent_id").alias("path"))
    found = paths
    for _ in range(max_depth - 1):
        # A reply has one parent, so a step looks up at most ``limit`` ids among the messages, without their texts.
        last, walked = F.element_at("path", -1), F.slice("path", 1, F.size("path") - 1)
        heads = small(paths.filter(~F.array_contains(walked, last)).withColumn("child_id", last), limit)
        steps = g.messages.select(F.col("id").alias("child_id"), "parent_id").join(heads, "child_id")
        nodes = g.message_taxonomy.select(F.col("message_id").alias("parent_id"))
        known = g.messages.select(F.col("id").alias("parent_id"))
        paths = steps.join(nodes, "parent_id", "left_semi").join(known, "parent_id", "left_semi").select(F.concat("path", F.array("parent_id")).alias("path"))
        found = found.unionByName(paths)
    return top(found, limit, F.asc("path"))


def vocal_integration_users(g: Corpus, category: str = "integration_requests", min_mentions: int = 3) -> DataFrame:
    counts = g.facts([category]).groupBy("author_id").agg(F.count("*").alias("n")).filter(F.col("n") > min_mentions)
    return counts.join(g.authors("username", "platform"), "author_id").orderBy(F.desc("n"), "author_id").select(
        "username", "platform", "n"
    )


def feature_and_integration_pairs(g: Corpus, a: str = "feature_requests", b: str = "integration_requests",
                                  limit: int = 50) -> DataFrame:
    """The first (user, m1, m2) triples with m1 in category a and m2 in b.

    Ordered by user and ids, the first ``limit`` triples belong to the first
    ``limit`` users with both categories, and use the first ``limit`` ids of each;
    a triple at ranks (i, j) has at least i * j - 1 triples before it.
    """
    rows = g.facts([a, b])
    both = rows.groupBy("author_id").agg(
        F.count_if(F.col("category") == a).alias("n_a"), F.count_if(F.col("category") == b).alias("n_b")
    ).filter("n_a > 0 AND n_b > 0")
    users = small(top(both.join(g.authors(), "author_id", "left_semi"), limit, F.asc("author_id")).select("author_id"), limit)
    first = first_per(rows.join(users, "author_id", "left_semi"), ["author_id", "category"], [F.asc("id")], limit)
    # At most ``limit`` ids per list, for at most ``limit`` users.
    lists = first.groupBy("author_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("category") == c, F.col("id")))).alias(name) for name, c in (("a", a), ("b", b))
    ])
    pairs = (
        lists.select("author_id", "b", F.posexplode("a").alias("i", "m1"))
        .select("author_id", "i", "m1", F.posexplode("b").alias("j", "m2"))
        .filter((F.col("i") + 1) * (F.col("j") + 1) <= limit)
    )
    return top(pairs, limit, F.asc("author_id"), F.asc("m1"), F.asc("m2")).select(
        F.col("author_id").alias("user_id"), "m1", "m2"
    )


def auth_and_integration_counts(g: Corpus, a: str = "authentication_needs", b: str = "integration_requests") -> DataFrame:
    """Messages in both categories by username; a user must hold both before namesakes merge."""
    per_user = g.facts([a, b]).groupBy("author_id").agg(
        F.count_if(F.col("category") == a).alias("n_a"), F.count_if(F.col("category") == b).alias("n_b")
    ).filter("n_a > 0 AND n_b > 0")
    return (
        per_user.join(g.authors("username"), "author_id").groupBy("username")
        .agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
        .orderBy(F.desc(F.col("n_a") + F.col("n_b")), "username")
    )


def category_distribution(g: Corpus) -> DataFrame:
    counts = g.facts().groupBy(F.col("category").alias("name")).agg(F.count("*").alias("n"))
    everything = g.classified_messages().agg(F.count("*")).scalar()
    n = F.coalesce("n", F.lit(0))
    return g.taxonomy.join(counts, "name", "left").select(
        F.col("name").alias("category"), "description", n.alias("n"), pct(n, everything).alias("pct")
    ).orderBy(F.desc("n"), "category")


def platform_by_category(g: Corpus) -> DataFrame:
    return g.facts(None, "platform").groupBy("category", "platform").agg(F.count("*").alias("n")).orderBy(
        "category", F.desc("n"), "platform"
    )


def daily_timeline(g: Corpus) -> DataFrame:
    day = F.to_date(utc_timestamp("timestamp")).alias("date")
    return g.classified_messages("timestamp").groupBy(day).agg(F.count("*").alias("n")).orderBy("date")


def activity_histogram(g: Corpus) -> DataFrame:
    return g.users.groupBy("message_count").agg(F.count("*").alias("users")).orderBy("message_count")


def graph_sample(g: Corpus, limit: int = 200) -> DataFrame:
    return _edges(g, None, limit, with_user=True)


def actionable_edges(g: Corpus, limit: int = 200) -> DataFrame:
    return _edges(g, [c for c in g.categories if c not in fv.NON_ACTIONABLE], limit, with_user=False)


def small_category_subgraph(g: Corpus, categories: Sequence[str] = fv.SMALL_CATEGORIES) -> DataFrame:
    return _edges(g, categories, None, with_user=True)
