"""The Jaccard join and its components against all pairs."""

import random

import numpy as np
from brute import jaccard_components, shingles
from pyspark.sql import functions as F

from chatterlens.llm import ngram_join
from chatterlens.llm.components import components


def found(docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}


def test_shingle_sets_follow_the_definition():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices(["a", "B", "é", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", "word "], k=rng.randint(0, 60)))
        assert len(ngram_join.shingle_set(text, 5)) == len(shingles(text))
        assert np.array_equal(ngram_join.shingle_set(text, 5), ngram_join.shingle_set("  " + text.replace(" ", "\n  "), 5))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(1000 + i, 999) for i in range(50)]
    ring = [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)]
    rows = spark.createDataFrame(chain + star + ring + [(5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(rows).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[1049] == 999 and {got[2000 + i] for i in range(7)} == {2000}
    assert components(rows.limit(0)).count() == 0


def near_copies(seed):
    """Groups of edited copies around the threshold, chains of copies of copies, shared passages, short texts."""
    rng = random.Random(seed)
    fresh = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    passage, texts = fresh(40), []
    for _ in range(12):
        base = fresh(rng.randint(6, 120))
        if rng.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        group = [base]
        for _ in range(rng.randint(0, 14)):
            words = list(rng.choice(group))
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = fresh(1)[0]
            group.append(words)
        texts += group
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(9000, "a b"), (9001, "A  b"), (9002, "a b c"), (9003, ""), (9004, None), (9005, "\n"), (9006, rows[0][1].upper())]


def test_join_equals_all_pairs(spark):
    rows = near_copies(1) + [(i + 20_000, t) for i, t in near_copies(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == jaccard_components(rows)


def test_least_sampled_is_the_least_over_all_partners(spark):
    def plain(n, percent):
        up = lambda a, b: -(-a // b)
        found = []
        for m in range(up(percent * n, 100), 100 * n // percent + 1):
            i = up(percent * (n + m), 100 + percent)
            found += [up(30 * n, 100) - (n - i), up(30 * m, 100) - (m - i)]
        return min(found)

    for percent in (60, 80, 95):
        rows = spark.range(1, 400).select("id", ngram_join.least_sampled(F.col("id"), percent).alias("need")).collect()
        assert all(r["need"] == plain(r["id"], percent) for r in rows)


def test_sets_within_larger_ones_link(spark):
    """Texts beside the same text with words added at the end, at a similarity of exactly 0.8."""
    rng = random.Random(5)
    rows = []
    for small, large, times in ((4, 5, 100), (8, 10, 200), (24, 30, 2000)):
        for _ in range(times):
            words = [f"{rng.randrange(10**9)}" for _ in range(large + 4)]
            rows += [(len(rows), " ".join(words[: small + 4])), (len(rows) + 1, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {i: c for i, (_, c) in found(docs).items()} == {i: i - i % 2 for i, _ in rows}


def test_star_of_copies_without_direct_links(spark):
    """Copies that link with their original only, and a large group with one prefix."""
    base = [f"b{i}" for i in range(100)]
    rows = [(500, " ".join(base))]
    for i in range(60):
        words = list(base)
        words[i + 20] = f"x{i}"
        words[(i * 7 + 50) % 100] = f"y{i}"
        rows.append((i, " ".join(words)))
    rows += [(700 + i, " ".join(f"c{k}" for k in range(80)) + f" z{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == jaccard_components(rows)


def test_join_odd_rows(odd_docs, no_docs):
    rows = ngram_join.jaccard_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert all(r["component_id"] is None and r["component"] is None for r in by_id[None])
    assert {r["component_id"] for i in (1, 2, 3) for r in by_id[i]} == {1, 2, 3} and by_id[1][0]["n_shingles"] == 0
    assert [r["component_id"] for i in (5, 6) for r in by_id[i]] == [4, 4]
    assert len({r["component"] for r in by_id[4]}) == 2  # two equal rows and another text under the same id
    assert by_id[9][0]["component_id"] == by_id[10][0]["component_id"] == 9 and by_id[11][0]["component_id"] == 11
    assert ngram_join.jaccard_components(no_docs).count() == 0
