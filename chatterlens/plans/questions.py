"""Analysis questions over users, messages and categories.

Shared shape: count per user on narrow columns (combined before the shuffle),
join the user table to the counts, keep the top k, and only then fetch texts
for the few rows kept. A user who wrote a third of all messages is one row
after the first aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlens.functions import fixed_values as fv
from chatterlens.functions.columns import (
    first_per, name_bit, names_in_bits, newest_first, ordered_list, pct, ratio, small, top, utc_timestamp,
)
from chatterlens.functions.skew import spread_join
from chatterlens.session import written_once
from chatterlens.sources.corpus import Corpus



def _counts(g: Corpus, categories: Sequence[str], name: str = "n") -> DataFrame:
    return g.facts(categories).groupBy("author_id").agg(F.count("*").alias(name))


def _with_samples(g: Corpus, picked: DataFrame, categories: Sequence[str], k: int, samples: int) -> DataFrame:
    """Add each picked user's newest texts in the categories; ids first, texts last."""
    chosen = small(picked.select("author_id"), k)
    narrow = g.messages.select("id", "author_id", "timestamp").join(chosen, "author_id", "left_semi")
    rows = narrow.join(g.labels(categories).withColumnRenamed("message_id", "id"), "id")
    keys = first_per(rows, ["author_id"], [*newest_first(), F.asc("category")], samples).select("id", "author_id", "rank")
    texts = (
        g.fetch(keys, k * samples, "content")
        .groupBy("author_id").agg(ordered_list("rank", "content").alias("samples"))
    )
    # Every picked user has texts. An inner join and a final sort also keep a later
    # limit from being pushed below the ranking.
    return picked.join(texts, "author_id").orderBy(F.desc("n"), "author_id")


def _requesters(g: Corpus, category: str, k: int, samples: int) -> DataFrame:
    counts = _counts(g, [category]).join(
        g.authors("username", "platform", F.col("message_count").alias("total_messages")), "author_id"
    )
    picked = top(counts.filter("total_messages > 0"), k, F.desc("n"), F.asc("author_id"))
    return _with_samples(g, picked, [category], k, samples)


def top_complainers(g: Corpus, category: str = "pricing_complaints", k: int = 20, samples: int = 3) -> DataFrame:
    share = pct(F.col("n"), F.col("total_messages")).alias("pct")
    return _requesters(g, category, k, samples).select(
        "username", "platform", F.col("n").alias("complaints"), "total_messages", share, "samples"
    )


def top_requesters(g: Corpus, category: str, k: int = 20, samples: int = 3) -> DataFrame:
    return _requesters(g, category, k, samples).select("username", "platform", "n", "total_messages", "samples")


def top_integration_requesters(g: Corpus, k: int = 20) -> DataFrame:
    return top_requesters(g, "integration_requests", k)


def serial_bug_reporters(g: Corpus, k: int = 20) -> DataFrame:
    return top_requesters(g, "bug_reports", k)


def _multi(g: Corpus, categories: Sequence[str], min_types: int) -> DataFrame:
    """Users with enough distinct categories: their set and their (message, category) pairs."""
    return (
        g.facts(categories).groupBy("author_id")
        .agg(F.bit_or(name_bit("category", categories)).alias("bits"), F.count("*").alias("total"))
        .filter(F.bit_count("bits") >= min_types)
        .select("author_id", names_in_bits("bits", categories).alias("types"), "total")
    )


def multi_category_complainers(g: Corpus, categories: Sequence[str] = fv.COMPLAINT_CATEGORIES,
                               min_types: int = 3, k: int = 20) -> DataFrame:
    rows = _multi(g, categories, min_types).join(
        g.authors("username", "platform", "message_count").filter("message_count > 0"), "author_id"
    )
    return top(rows, k, F.desc("total"), F.asc("author_id")).select(
        "username", "platform", "types", "total", F.size("types").alias("n_types")
    )


def category_by_platform(g: Corpus, category: str) -> DataFrame:
    """Count per platform and share of the category."""
    counts = g.facts([category], "platform").groupBy("platform").agg(F.count("*").alias("n"))
    everything = F.sum("n").over(Window.partitionBy())
    return counts.select("platform", "n", pct(F.col("n"), everything).alias("pct")).orderBy(F.desc("n"), "platform")


def pricing_by_platform(g: Corpus) -> DataFrame:
    return category_by_platform(g, "pricing_complaints")


def integration_by_platform(g: Corpus) -> DataFrame:
    return category_by_platform(g, "integration_requests")


def category_platform_pivot(g: Corpus) -> DataFrame:
    counts = g.facts(None, "platform").groupBy("category").agg(
        F.count_if(F.col("platform") == "discord").alias("discord"),
        F.count_if(F.col("platform") == "reddit").alias("reddit"),
        F.count("*").alias("total"),
    )
    return counts.withColumn("discord_pct", pct(F.col("discord"), F.col("total"))).orderBy(F.desc("total"), "category")


def platform_user_behavior(g: Corpus) -> DataFrame:
    return (
        g.users.groupBy("platform")
        .agg(
            F.count("*").alias("users"),
            ratio(F.sum("message_count"), F.count("message_count")).alias("avg_messages"),
            F.max("message_count").alias("max_messages"),
        )
        .orderBy(F.desc("users"), "platform")
    )


def _both(g: Corpus, a: str, b: str) -> DataFrame:
    """Per user id the messages in each of two categories, both present; one pass instead of a product."""
    return (
        g.facts([a, b]).groupBy("author_id")
        .agg(F.count_if(F.col("category") == a).alias("n_a"), F.count_if(F.col("category") == b).alias("n_b"))
        .filter("n_a > 0 AND n_b > 0")
    )


_PERSON = ["username", "platform", "message_count"]


def wants_both(g: Corpus, a: str, b: str, k: int = 20) -> DataFrame:
    """People (same name, platform and activity) with messages in both categories."""
    rows = _both(g, a, b).join(g.authors(*_PERSON), "author_id").groupBy(*_PERSON).agg(
        F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b")
    )
    return top(rows, k, F.desc(F.col("n_a") + F.col("n_b")), *[F.asc(c) for c in _PERSON]).select(
        "username", "platform", "n_a", "n_b", F.col("message_count").alias("total_messages")
    )


def wants_integration_and_auth(g: Corpus, a: str = "integration_requests", b: str = "authentication_needs",
                               k: int = 20) -> DataFrame:
    return wants_both(g, a, b, k)


def bugs_and_performance(g: Corpus, a: str = "bug_reports", b: str = "performance_issues", k: int = 20,
                         samples: int = 2) -> DataFrame:
    """As wants_both, with the first distinct texts of category a in text order.

    One partial aggregate per sample: the least text, then the least one above it, and so on.
    """
    rows = wants_both(g, a, b, k).withColumnRenamed("total_messages", "message_count")
    chosen = small(rows.select(*_PERSON), k)
    people = g.authors(*_PERSON).join(chosen, _PERSON, "left_semi").join(_both(g, a, b).select("author_id"), "author_id", "left_semi")
    ids = g.messages.select("id", "author_id").join(people, "author_id").join(
        g.labels([a]).select(F.col("message_id").alias("id")), "id", "left_semi")
    texts = g.messages.select("id", "content").join(ids, "id").select(*_PERSON, "content")
    found = texts.groupBy(*_PERSON).agg(F.min("content").alias("s0"))
    for i in range(1, samples):
        above = texts.join(found.select(*_PERSON, F.col(f"s{i - 1}").alias("below")), _PERSON).filter(F.col("content") > F.col("below"))
        found = found.join(above.groupBy(*_PERSON).agg(F.min("content").alias(f"s{i}")), _PERSON, "left")
    picked = found.select(*_PERSON, F.array_compact(F.array(*[f"s{i}" for i in range(samples)])).alias("samples"))
    return rows.join(picked, _PERSON).orderBy(F.desc(F.col("n_a") + F.col("n_b")), *_PERSON).withColumnRenamed(
        "message_count", "total_messages"
    )


def feature_wishlist_champions(g: Corpus, k: int = 15, samples: int = 5) -> DataFrame:
    counts = _counts(g, ["feature_requests"]).join(g.authors("username", "platform"), "author_id")
    picked = top(counts, k, F.desc("n"), F.asc("author_id"))
    return _with_samples(g, picked, ["feature_requests"], k, samples).select("username", "platform", "n", "samples")


def customization_seekers(g: Corpus) -> DataFrame:
    """One row per text, with the number of texts by (username, platform)."""
    keys = ["username", "platform"]
    counted = (
        _counts(g, ["customization_requests"]).join(g.authors(*keys), "author_id")
        .groupBy(*keys).agg(F.sum("n").alias("n"))
    )
    rows = g.facts(["customization_requests"], "timestamp", "content").join(g.authors(*keys), "author_id").select(
        *keys, "id", "timestamp", "content"
    )
    return spread_join(rows, counted, keys, "id").select(*keys, "n", "timestamp", "id", "content")


def export_integration_requesters(g: Corpus, k: int = 100) -> DataFrame:
    """One row per text of the top requesters, with their number of texts."""
    counted = _counts(g, ["integration_requests"]).join(
        g.authors("username", "platform", F.col("message_count").alias("total_messages")), "author_id"
    )
    picked = small(top(counted, k, F.desc("n"), F.asc("author_id")), k)
    theirs = g.messages.select("id", "author_id", "timestamp", "content").join(picked, "author_id")
    rows = theirs.join(g.labels(["integration_requests"]).select(F.col("message_id").alias("id")), "id", "left_semi")
    return rows.select("username", "platform", "total_messages", "n", "timestamp", "id", "content")


def _short_cycles(links: DataFrame, max_depth: int) -> DataFrame | None:
    """(id, length) of the messages on reply cycles shorter than ``max_depth``; None without any.

    Longer cycles need no care: no path of ``max_depth`` replies takes one of theirs twice.
    """
    up = links.select(F.col("child_id").alias("at"), F.col("parent_id").alias("next"))
    walks, found = links.select(F.col("child_id").alias("id"), F.col("parent_id").alias("at")), []
    for length in range(2, max_depth):
        walks = walks.join(up, "at").select("id", F.col("next").alias("at"))
        found.append(walks.filter("id = at").select("id", F.lit(length).alias("length")))
        walks = walks.filter("id <> at")
    if not found:
        return None
    cyclic = written_once(reduce(DataFrame.unionByName, found).groupBy("id").agg(F.min("length").alias("length")))
    return None if cyclic.isEmpty() else cyclic


def _round_cycles(cyclic: DataFrame, links: DataFrame, ends: DataFrame, max_depth: int) -> DataFrame:
    """(id, paths) of the messages on short cycles, from the counts of the paths that come to them from outside.

    With t replies from its start to the first message x on the cycle, a path ends o further on with t + o replies, for
    every o below the cycle's length, and again at x after the whole round.
    """
    one = F.lit(1).cast("bigint")
    none = F.array(*[F.lit(0).cast("bigint")] * max_depth)
    outside = cyclic.join(ends, "id", "left").select("id", "length", F.concat(F.array(one), F.coalesce("paths", none)).alias("come"))
    up = links.select(F.col("child_id").alias("id"), F.col("parent_id").alias("next"))
    at, reached = outside.withColumn("o", F.lit(0)), []
    for step in range(max_depth - 1):
        reached.append(at)
        at = at.filter(F.col("length") > step + 1).join(up, "id").select(F.col("next").alias("id"), "length", "come", F.lit(step + 1).alias("o"))
    rows = written_once(reduce(DataFrame.unionByName, reached))

    def paths(d: int) -> Column:
        straight = F.when(F.lit(d) >= F.col("o"), F.get("come", F.lit(d) - F.col("o"))).otherwise(0)
        whole_round = F.when((F.col("o") == 0) & (F.col("length") <= d), F.get("come", F.lit(d) - F.col("length"))).otherwise(0)
        return F.sum(straight + whole_round)

    return rows.groupBy("id").agg(F.array(*[paths(d) for d in range(1, max_depth + 1)]).alias("paths"))


def thread_depth_by_topic(g: Corpus, max_depth: int = 5) -> DataFrame:
    """Reply paths of 1..max_depth hops by the category of the message they end in.

    Each round adds up, per message, the path counts of its direct replies moved one
    hop further. Only counts travel: a message with very many replies is one row
    after the partial sums, and no path is ever listed. A path takes no reply twice:
    one that comes to a message replying to itself may take that loop once, and one
    that enters a cycle may go round it once (see ``_round_cycles``).
    """
    edges = written_once(g.replies())
    loops = edges.filter("child_id = parent_id").select(F.col("child_id").alias("id"), F.lit(1).alias("loop"))
    links = edges.filter("child_id <> parent_id")
    cyclic = _short_cycles(links, max_depth)
    if cyclic is not None:
        every, links = links, links.join(cyclic.select(F.col("id").alias("child_id")), "child_id", "left_anti")
    hops = [f"p{d}" for d in range(1, max_depth + 1)]
    counts = links.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("p1"))
    for depth in range(2, max_depth + 1):
        below = [F.sum(F.coalesce(f"p{d}", F.lit(0))).alias(f"p{d + 1}") for d in range(1, depth)]
        counts = (
            links.join(counts.withColumnRenamed("id", "child_id"), "child_id", "left")
            .groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("p1"), *below)
        )
    zero = F.lit(0).cast("bigint")
    paths = F.array(*[F.coalesce(p, zero) for p in hops])
    ends = counts.join(loops, "id", "full_outer").select(
        "id",
        F.when(F.col("loop").isNull(), paths).otherwise(
            F.zip_with(paths, F.slice(F.concat(F.array(F.lit(1).cast("bigint")), paths), 1, max_depth), lambda a, b: a + b)
        ).alias("paths"),
    )
    if cyclic is not None:
        ends = ends.join(cyclic, "id", "left_anti").unionByName(_round_cycles(cyclic, every, ends, max_depth))
    n = F.aggregate("paths", zero, lambda a, x: a + x)
    steps = F.aggregate(F.transform("paths", lambda x, i: x * (i + 1)), zero, lambda a, x: a + x)
    deepest = F.array_max(F.transform("paths", lambda x, i: F.when(x > 0, i + 1).otherwise(0)))
    per_end = ends.select("id", n.alias("n"), steps.alias("steps"), deepest.alias("longest"))
    topics = per_end.join(g.labels().withColumnRenamed("message_id", "id"), "id")
    return (
        topics.groupBy(F.col("category").alias("topic"))
        .agg(
            F.count("*").alias("thread_starters"), F.max("longest").alias("longest"),
            (F.sum("steps") / F.sum("n")).alias("avg_depth"),
        )
        .orderBy(F.desc("thread_starters"), "topic")
    )


def escalations_to_pricing(g: Corpus, to: str = "pricing_complaints", samples: int = 3) -> DataFrame:
    """Replies of one category to parents without it, by the parent's category.

    Replies are counted and cut to the newest few per parent before the parents'
    categories are joined, so a parent with very many replies is a few rows.
    """
    target = g.labels([to]).select("message_id")
    pairs = (
        g.messages.filter(F.col("parent_id").isNotNull() & (F.col("parent_id") != ""))
        .select("id", "parent_id", "timestamp")
        .join(target.withColumnRenamed("message_id", "id"), "id", "left_semi")
    )
    started = (
        g.labels().join(target, "message_id", "left_anti")
        .join(g.messages.select(F.col("id").alias("message_id")), "message_id", "left_semi")
        .select(F.col("message_id").alias("parent_id"), F.col("category").alias("started_as"))
    )
    counted = pairs.groupBy("parent_id").agg(F.count("*").alias("n"))
    per_parent = first_per(pairs, ["parent_id"], newest_first(), samples, "place").join(counted, "parent_id")
    by_topic = per_parent.join(started, "parent_id")
    counts = by_topic.filter("place = 1").groupBy("started_as").agg(F.sum("n").alias("n"))
    picked = first_per(by_topic, ["started_as"], newest_first(), samples).select("id", "started_as", "rank")
    texts = g.fetch(picked, samples * len(g.categories), "content").groupBy("started_as").agg(
        ordered_list("rank", "content").alias("samples")
    )
    return counts.join(texts, "started_as").orderBy(F.desc("n"), "started_as")


def influential_thread_starters(g: Corpus, k: int = 20) -> DataFrame:
    replies = g.reply_counts().select(F.col("parent_id").alias("id"), F.col("n").alias("replies"))
    rows = g.facts(None, "platform").join(replies, "id").join(
        g.authors(F.col("username").alias("author")), "author_id"
    )
    picked = top(rows, k, F.desc("replies"), F.asc("id"), F.asc("category")).drop("author_id")
    return g.fetch(picked, k, "content").orderBy(F.desc("replies"), "id", "category").select(
        "category", "author", F.col("content").alias("message"), "replies", "platform"
    )


def power_users_by_category(g: Corpus, categories: Sequence[str] = fv.OPPORTUNITY_CATEGORIES, n: int = 5) -> DataFrame:
    counts = g.facts(categories).groupBy("category", "author_id").agg(F.count("*").alias("count"))
    ranked = first_per(
        counts.join(g.authors("username", "platform"), "author_id"), ["category"], [F.desc("count"), F.asc("author_id")], n
    )
    user = F.struct("username", "platform", "count")
    return ranked.groupBy("category").agg(ordered_list("rank", user).alias("top_users")).orderBy("category")


def user_segments(g: Corpus, bounds: Sequence[int] = fv.SEGMENT_BOUNDS, names: Sequence[str] = fv.SEGMENT_NAMES) -> DataFrame:
    """Users by activity segment, most active segment first."""
    segment = F.lit(len(bounds) + 1)
    for place in reversed(range(len(bounds))):
        segment = F.when(F.col("message_count") >= bounds[place], place + 1).otherwise(segment)
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("place") - 1)
    counts = g.users.groupBy(segment.alias("place")).agg(
        F.count("*").alias("users"), ratio(F.sum("message_count"), F.count("message_count")).alias("avg_messages")
    )
    everyone = F.sum("users").over(Window.partitionBy())
    return counts.withColumn("pct", pct(F.col("users"), everyone)).orderBy("place").select(
        name.alias("user_type"), "users", "avg_messages", "pct"
    )


def questions_then_complaints(g: Corpus, from_category: str = "questions",
                              to_categories: Sequence[str] = fv.ESCALATION_CATEGORIES, k: int = 20) -> DataFrame:
    """Complaints later than the user's first question, by type."""
    first = g.facts([from_category], "timestamp").groupBy("author_id").agg(F.min("timestamp").alias("asked"))
    complaints = g.facts(to_categories, "timestamp")
    later = spread_join(complaints, first, "author_id", "id").filter(F.col("timestamp") > F.col("asked"))
    counts = later.groupBy("author_id", F.col("category").alias("complaint_type")).agg(F.count("*").alias("n"))
    rows = counts.join(g.authors("username", "platform", F.col("message_count").alias("total_messages")), "author_id")
    return top(rows, k, F.desc("n"), F.asc("author_id"), F.asc("complaint_type")).select(
        "username", "platform", "complaint_type", "n", "total_messages"
    )


def _by_person(g: Corpus, category: str, people: DataFrame, keys: Sequence[str], k: int, samples: int) -> DataFrame:
    """Counts and newest texts by person keys, where several users may share the keys."""
    counts = _counts(g, [category]).join(people, "author_id").groupBy(*keys).agg(F.sum("n").alias("n"))
    picked = small(top(counts, k, F.desc("n"), *[F.asc(c) for c in keys]), k)
    members = people.join(picked.select(*keys), list(keys), "left_semi")
    rows = (
        g.messages.select("id", "author_id", "timestamp").join(members, "author_id")
        .join(g.labels([category]).select(F.col("message_id").alias("id")), "id", "left_semi")
    )
    ids = first_per(rows, keys, newest_first(), samples).select("id", *keys, "rank")
    texts = g.fetch(ids, k * samples, "content").groupBy(*keys).agg(ordered_list("rank", "content").alias("samples"))
    return picked.join(texts, list(keys)).orderBy(F.desc("n"), *keys)


def reddit_pricing_complainers(g: Corpus, k: int = 15, samples: int = 3) -> DataFrame:
    people = g.users.filter("platform = 'reddit'").select(F.col("id").alias("author_id"), "username")
    return _by_person(g, "pricing_complaints", people, ["username"], k, samples).select("username", "n", "samples")


def discord_feature_power_users(g: Corpus, min_messages: int = 20, k: int = 15, samples: int = 3) -> DataFrame:
    people = g.users.filter((F.col("platform") == "discord") & (F.col("message_count") > min_messages)).select(
        F.col("id").alias("author_id"), "username", F.col("message_count").alias("total_messages")
    )
    return _by_person(g, "feature_requests", people, ["username", "total_messages"], k, samples).select(
        "username", "n", "total_messages", "samples"
    )


def auth_and_integration_users(g: Corpus, categories: Sequence[str] = fv.SECURITY_CATEGORIES) -> DataFrame:
    rows = _multi(g, categories, len(categories)).join(g.authors("username", "platform", "message_count"), "author_id")
    return rows.orderBy(F.desc("total"), "author_id").select(
        "username", "platform", F.col("total").alias("n"), F.col("message_count").alias("total_messages")
    )


def early_adopters_to_complainers(g: Corpus, categories: Sequence[str] = fv.ESCALATION_CATEGORIES,
                                  gap_days: int = 30, k: int = 20) -> DataFrame:
    """Users first seen more than gap_days before their first complaint."""
    complaints = g.facts(categories, "timestamp").groupBy("author_id").agg(
        F.min("timestamp").alias("first_complaint"), F.count("*").alias("n")
    )
    rows = complaints.join(g.authors("username", "platform", "message_count", "first_seen"), "author_id").filter(
        F.col("first_seen") < F.col("first_complaint") - gap_days * 86400
    )
    return top(rows, k, F.desc("n"), F.asc("author_id")).select(
        "username", "platform", "n", F.col("message_count").alias("total_messages"),
        utc_timestamp("first_seen").alias("joined"), utc_timestamp("first_complaint").alias("first_complaint"),
    )


def recent_in_category(g: Corpus, category: str = "integration_requests", k: int = 50) -> DataFrame:
    keys = top(g.facts([category], "timestamp", "platform"), k, *newest_first()).select("id", "timestamp", "platform")
    return g.fetch(keys, k, "content").orderBy(*newest_first()).select(
        F.col("content").alias("message"), "platform", utc_timestamp("timestamp").alias("posted_at")
    )


def _matching(g: Corpus, predicate, categories: Sequence[str] | None, k: int) -> DataFrame:
    """Newest labelled messages whose text matches; the text filter runs on the scan."""
    hits = g.messages.filter(predicate).select("id", "timestamp", "platform")
    rows = hits.join(g.labels(categories).withColumnRenamed("message_id", "id"), "id")
    keys = top(rows, k, *newest_first(), F.asc("category"))
    return g.fetch(keys, k, "content").orderBy(*newest_first(), "category").select(
        F.col("content").alias("message"), "category", "platform", utc_timestamp("timestamp").alias("posted_at")
    )


def keyword_search(g: Corpus, term: str = "stripe", k: int = 30) -> DataFrame:
    return _matching(g, F.contains(F.lower("content"), F.lit(term)), None, k)


def price_mentions(g: Corpus, category: str = "pricing_complaints", k: int = 30) -> DataFrame:
    """Texts that name a price; the pattern covers the whole text and a dot stops at a line break."""
    # The two price patterns, as full matches.
    dollars, monthly = r"\A.*\$[0-9]+.*\z", r"\A.*[0-9]+/mo.*\z"
    predicate = F.col("content").rlike(dollars) | F.col("content").rlike(monthly)
    return _matching(g, predicate, [category], k).drop("category")


def top5_complainer_subgraph(g: Corpus, category: str = "pricing_complaints", k: int = 5) -> DataFrame:
    """The top users of a category with all their messages in it."""
    counts = _counts(g, [category]).join(g.authors(), "author_id")
    picked = small(top(counts, k, F.desc("n"), F.asc("author_id")).select("author_id"), k)
    return (
        g.messages.select("id", "author_id").join(picked, "author_id", "left_semi")
        .join(g.labels([category]).withColumnRenamed("message_id", "id"), "id")
        .select(F.col("author_id").alias("user_id"), F.col("id").alias("message_id"), "category")
    )


def integration_requester_network(g: Corpus, category: str = "integration_requests", min_requests: int = 3,
                                  limit: int = 100) -> DataFrame:
    """Newest messages of users with enough requests."""
    users = _counts(g, [category]).filter(F.col("n") >= min_requests).join(g.authors(), "author_id", "left_semi")
    rows = spread_join(g.facts([category], "timestamp"), users.select("author_id"), "author_id", "id", "left_semi")
    return top(rows, limit, *newest_first()).select(
        F.col("author_id").alias("user_id"), F.col("id").alias("message_id"), "category"
    )


def multi_complainer_subgraph(g: Corpus, categories: Sequence[str] = fv.COMPLAINT_CATEGORIES, min_types: int = 3,
                              limit: int = 50, messages: int = 10) -> DataFrame:
    """Users with enough complaint types: their categories and newest messages."""
    users = top(_multi(g, categories, min_types).join(g.authors(), "author_id", "left_semi"), limit, F.asc("author_id"))
    chosen = small(users.select("author_id"), limit)
    narrow = g.messages.select("id", "author_id", "timestamp").join(chosen, "author_id", "left_semi")
    rows = narrow.join(g.labels(categories).withColumnRenamed("message_id", "id"), "id")
    ids = first_per(rows, ["author_id"], [*newest_first(), F.asc("category")], messages).groupBy("author_id").agg(
        ordered_list("rank", "id").alias("messages")
    )
    return users.join(ids, "author_id").select(
        F.col("author_id").alias("user_id"), F.col("types").alias("categories"), "messages"
    )


def category_summary(g: Corpus) -> DataFrame:
    """Messages, users and share of all labelled messages per category, zero rows kept."""
    per_user = g.facts().groupBy("category", "author_id").agg(F.count("*").alias("n"))
    known = per_user.join(g.authors(F.lit(1).alias("known")), "author_id", "left")
    counts = known.groupBy(F.col("category").alias("name")).agg(F.sum("n").alias("messages"), F.count("known").alias("users"))
    everything = g.classified_messages().agg(F.count("*")).scalar()
    n, u = F.coalesce("messages", F.lit(0)), F.coalesce("users", F.lit(0))
    return g.taxonomy.join(counts, "name", "left").select(
        F.col("name").alias("category"), "description", n.alias("messages"), u.alias("users"),
        pct(n, everything, 2).alias("pct"),
    ).orderBy(F.desc("messages"), "category")


def reddit_super_users(g: Corpus, categories: Sequence[str] = fv.WISH_CATEGORIES, k: int = 20) -> DataFrame:
    people = g.users.filter("platform = 'reddit'").select(
        F.col("id").alias("author_id"), "username", F.col("message_count").alias("total_messages")
    )
    per_user = g.facts(categories).groupBy("author_id", "category").agg(F.count("*").alias("n"))
    rows = per_user.join(people, "author_id").groupBy("username", "total_messages").agg(
        F.sum("n").alias("n"), F.bit_or(name_bit("category", categories)).alias("bits")
    )
    return top(rows, k, F.desc("n"), F.asc("username"), F.asc("total_messages")).select(
        "username", "n", "total_messages", names_in_bits("bits", categories).alias("categories")
    )


def discord_pain_points(g: Corpus, platform: str = "discord", categories: Sequence[str] = fv.PAIN_CATEGORIES) -> DataFrame:
    counts = g.facts(categories, "platform").filter(F.col("platform") == platform).groupBy("category").agg(
        F.count("*").alias("n")
    )
    everything = g.classified_messages("platform").filter(F.col("platform") == platform).agg(F.count("*")).scalar()
    return counts.select("category", "n", pct(F.col("n"), everything, 2).alias("pct")).orderBy(F.desc("n"), "category")


def opportunity_heatmap(g: Corpus, categories: Sequence[str] = fv.OPPORTUNITY_CATEGORIES, names: int = 10) -> DataFrame:
    """Messages, users and first usernames per category and platform."""
    keys = ["category", "platform"]
    per_user = g.facts(categories, "platform").groupBy(*keys, "author_id").agg(F.count("*").alias("n"))
    people = per_user.join(g.authors("username"), "author_id")
    counts = people.groupBy(*keys).agg(F.sum("n").alias("messages"), F.count("*").alias("users"))
    first = first_per(people.select(*keys, "username").distinct(), keys, [F.asc("username")], names)
    sample = first.groupBy(*keys).agg(ordered_list("rank", "username").alias("sample_users"))
    return counts.join(sample, keys).withColumn(
        "avg_per_user", ratio(F.col("messages"), F.col("users"))
    ).orderBy(F.desc("messages"), *keys)
