"""Graph edges, questions on the small corpus, and exactness under skew and against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from chatterlens import schemas
from chatterlens.functions.columns import pct, ratio
from chatterlens.functions.skew import spread_join
from chatterlens.operators import graph as gr
from chatterlens.plans import explore as ex
from chatterlens.plans import questions as qu
from chatterlens.sources.corpus import Corpus

CATEGORIES = ["integration_requests", "feature_requests", "bug_reports", "questions", "pricing_complaints"]


def corpus(spark, posts, users=None):
    """posts: (id, author, timestamp, parent, [categories], [entities])."""
    messages = spark.createDataFrame([(i, "discord", f"text {i}", a, t, t, "s", p, None) for i, a, t, p, _, _ in posts], schemas.MESSAGES)
    labels = spark.createDataFrame([(1, i, c, 0) for i, *_, cs, _ in posts for c in cs], schemas.MESSAGE_TAXONOMY)
    ents = spark.createDataFrame(
        [(n, i, "integration", e, None, None, None, None, None) for n, (i, *_, e) in enumerate((i, e) for i, *_, es in posts for e in es)],
        schemas.ENTITIES,
    )
    authors = users or sorted({a for _, a, *_ in posts})
    people = spark.createDataFrame([(a, "discord", f"name {a}", None, 1, 0, 0, None) for a in authors], schemas.USERS)
    return Corpus(messages=messages, users=people, message_taxonomy=labels, extracted_entities=ents)


def random_posts(seed, n=400, people=30):
    rng = random.Random(seed)
    posts = []
    for i in range(n):
        # One author writes a third of everything and asks for everything.
        author = "u0" if rng.random() < 0.34 else f"u{rng.randrange(1, people)}"
        cats = rng.sample(CATEGORIES, rng.choice([1, 1, 1, 2])) if rng.random() < 0.9 else []
        ents = [f"e{rng.randrange(40)}"] if author == "u0" else [f"e{int(rng.random() ** 2 * 12)}"]
        parent = f"m{0 if rng.random() < 0.4 else rng.randrange(i)}" if i and rng.random() < 0.7 else None
        posts.append((f"m{i}", author, 1000 + i, parent, cats, ents))
    return posts


def test_small_graph(small_corpus):
    g = small_corpus
    assert {(r.name, r.message_count) for r in gr.category_nodes(g).collect() if r.message_count} == {
        ("integration_requests", 1), ("questions", 1), ("pricing_complaints", 2)}
    assert {r.id: r.category for r in gr.message_nodes(g).collect()}["reddit_t3_2"] == "pricing_complaints"
    assert gr.posted_edges(g).count() == 3 and gr.classified_as_edges(g).count() == 4
    assert [tuple(r) for r in gr.replies_to_edges(g).collect()] == [("reddit_t1_3", "reddit_t3_2")]
    assert [(r.name, r.confidence) for r in gr.pain_points_by_confidence(g).collect()] == [("price", None), ("price", 0.5)]
    node = gr.entity_nodes(g.extracted_entities, "pain_point", "PainPoint").first()
    assert (node.label, node.name, node.frequency, node.severity) == ("PainPoint", "price", 2, 0.0)
    stats = {(r.kind, r.key): (r.n, r.pct) for r in gr.graph_stats(g).collect()}
    assert stats[("node", "Message")] == (3, None) and stats[("category", "pricing_complaints")] == (2, 66.7)
    assert {r.username: r.n for r in gr.user_message_counts(g).collect()} == {"ann": 1, "bob": 2}


def test_small_questions(small_corpus):
    g = small_corpus
    row = qu.top_complainers(g).first()
    assert (row.username, row.complaints, row.pct) == ("bob", 2, 100.0)
    assert row.samples == ["same here, 20/mo is too much", "Costs $20 a month\nsecond line"]
    # A full match with a dot that stops at line breaks misses the two-line text.
    assert [r.message for r in qu.price_mentions(g).collect()] == ["same here, 20/mo is too much"]
    assert qu.escalations_to_pricing(g).count() == 0
    assert [r.n for r in qu.questions_then_complaints(g).collect()] == [1]
    assert [tuple(r.path) for r in ex.deep_threads(g).collect()] == [("reddit_t1_3", "reddit_t3_2")]


def test_limits_after_ranking_keep_the_top(spark):
    g = corpus(spark, random_posts(3))
    full = [(r.username, r.n) for r in qu.feature_wishlist_champions(g).collect()]
    assert full == sorted(full, key=lambda x: -x[1])
    assert [(r.username, r.n) for r in qu.feature_wishlist_champions(g).limit(2).collect()] == full[:2]


def ring(name, size, tails):
    """A reply cycle with chains of replies that lead into it."""
    topics = ["questions", "bug_reports", "feature_requests"]
    posts = [(f"{name}{i}", "u1", i, f"{name}{(i + 1) % size}", [topics[i % 3]], []) for i in range(size)]
    for t, tail in enumerate(tails):
        posts += [(f"{name}_{t}_{j}", "u2", j, f"{name}{t % size}" if j == 0 else f"{name}_{t}_{j - 1}", [topics[(t + j) % 3]], []) for j in range(tail)]
    return posts


@pytest.mark.parametrize("rings", [[], [2], [3, 2], [4, 5, 6, 2]])
def test_thread_depth_against_walks(spark, rings):
    posts = random_posts(5, 200) + [("loop", "u1", 1, "loop", ["questions"], []), ("kid", "u1", 2, "loop", ["questions"], [])]
    posts += [p for i, size in enumerate(rings) for p in ring(f"r{i}x", size, [1, 3, 6])]
    g = corpus(spark, posts)
    labelled = {p[0]: p[4] for p in posts if p[4]}
    parent = {p[0]: p[3] for p in posts if p[3] and p[0] in labelled and p[3] in labelled}
    found = {}
    for start in parent:
        seen, node = set(), start
        for depth in range(1, 6):
            if node not in parent or node in seen:
                break
            seen.add(node)
            node = parent[node]
            for c in labelled[node]:
                found.setdefault(c, []).append((node, depth))
    out = {r.topic: (r.thread_starters, r.longest, round(r.avg_depth, 9)) for r in qu.thread_depth_by_topic(g).collect()}
    assert out == {
        c: (len({n for n, _ in v}), max(d for _, d in v), round(sum(d for _, d in v) / len(v), 9)) for c, v in found.items()
    }


def test_co_requested_against_all_pairs(spark):
    posts = random_posts(7)
    g = corpus(spark, posts)
    users = {}
    for _, author, _, _, cats, ents in posts:
        if cats:
            for e in ents:
                users.setdefault(e, set()).add(author)
    for threshold, shared in ((0.3, 1), (0.6, 1), (0.3, 2)):
        expected = {
            (a, b): (len(users[a] & users[b]), round(len(users[a] & users[b]) / len(users[a] | users[b]), 9))
            for a, b in itertools.combinations(sorted(users), 2)
            if len(users[a] & users[b]) / len(users[a] | users[b]) > threshold and len(users[a] & users[b]) >= shared
        }
        out = {(r.a, r.b): (r.n, round(r.strength, 9)) for r in gr.co_requested(g, threshold, min_shared=shared).collect()}
        assert expected and out == expected


def test_similar_users_against_all_pairs(spark):
    for seed, limit in ((11, 50), (12, 3), (13, 200)):
        posts = random_posts(seed, 120, 40)
        g = corpus(spark, posts)
        sets = {}
        for _, author, _, _, cats, _ in posts:
            if cats:
                sets.setdefault(author, set()).update(cats)
        pairs = sorted(
            (-len(sets[a] & sets[b]) / len(sets[a] | sets[b]), a, b) for a, b in itertools.combinations(sorted(sets), 2)
        )
        expected = [(a, b, round(-s, 9)) for s, a, b in pairs if -s > 0.5][:limit]
        out = [(r.a, r.b, round(r.score, 9)) for r in gr.similar_users(g, 0.5, limit).collect()]
        assert out == expected


def test_pairs_against_product(spark):
    posts = random_posts(17)
    g = corpus(spark, posts)
    by = lambda c: [(p[1], p[0]) for p in posts if c in p[4]]
    expected = sorted((u, a, b) for u, a in by("feature_requests") for v, b in by("integration_requests") if u == v)
    for limit in (5, 50, 400):
        out = [tuple(r) for r in ex.feature_and_integration_pairs(g, limit=limit).collect()]
        assert out == expected[:limit]


def test_spread_join_equals_join(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(f"i{i}", "hot" if i % 3 == 0 else f"k{rng.randrange(20)}") for i in range(900)], "id string, k string")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("none", 4)], "k string, v int")
    for how in ("inner", "left_semi", "left_anti", "left"):
        plain = left.join(right, "k", how).select("id", "k", *([] if "left_" in how else ["v"]))
        spread = spread_join(left, right, "k", "id", how, hot_rows=25).select(*plain.columns)
        assert sorted(plain.collect(), key=str) == sorted(spread.collect(), key=str)


def test_texts_of_hot_names_are_whole(spark):
    posts = [(f"m{i}", "u0" if i % 3 else "u1", i, None, ["customization_requests"], []) for i in range(300)]
    rows = qu.customization_seekers(corpus(spark, posts)).collect()
    for name, n in (("name u0", 200), ("name u1", 100)):
        texts = [r.content for r in rows if r.username == name]
        assert len(texts) == len(set(texts)) == n and {r.n for r in rows if r.username == name} == {n}


def test_one_heavy_user_pairs_nothing(spark):
    """Entities that one user alone asks for would all be alike; they need two shared users."""
    posts = [(f"m{i}", "u0", i, None, ["feature_requests"], [f"e{i}"]) for i in range(80)]
    posts += [(f"n{i}", f"u{i}", 500 + i, None, ["feature_requests"], ["x", "y"]) for i in range(1, 4)]
    assert [tuple(r)[:3] for r in gr.co_requested(corpus(spark, posts)).collect()] == [("x", "y", 3)]


def test_integer_rounding(spark):
    row = spark.range(1).select(
        pct(F.lit(1), F.lit(800)).alias("a"), pct(F.lit(201), F.lit(40000), 2).alias("b"), ratio(F.lit(9), F.lit(4)).alias("c"),
        pct(F.lit(1), F.lit(0)).alias("d"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == (0.1, 0.5, 2.3, None)
