"""Hard negatives and their tree against comparing every anchor with every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterlens.llm import gnat, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label long, id int, row string, block int, cell int, slots int"


def plain(rows, asked, positives=5, negatives=10, low=30, high=90):
    good = [(i, g, [int(np.floor(256 * float(x))) for x in v]) for i, v, g in rows
            if i is not None and g is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, g, a in good:
        if asked(i):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), j, h) for j, h, b in good if j != i)
            for p, j, _ in [s for s in scored if s[2] == g][:positives]:
                fits = [(s, m) for s, m, h in scored if h != g and low * -p <= 100 * -s <= high * -p][:negatives]
                out += [(i, j, r + 1, m, -p, -s) for r, (s, m) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("block, spread", [(30, 0.1), (4096, 0.1), (200, 1.0)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, spread):
    for name, value in {"BLOCK": block, "ANCHORS": 7, "TREES": 2, "ANCHOR_BLOCKS": 3, "SAMPLE": 100, "ROOT_POINTS": 6}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(block)
    middles = rng.normal(size=(9, 10))
    rows = [(i, [float(x) for x in middles[i % 9] + spread * rng.normal(size=10)], int(rng.integers(0, 4))) for i in range(700)]
    rows += [(1000 + i, rows[10][1], i % 4) for i in range(150)]  # copies: nothing splits them
    rows += [(2000 + i, [float(x) for x in np.round(rng.normal(size=10))], 1) for i in range(50)]  # ties
    rows += [(3000, None, 1), (3001, [1.0, None], 1), (3002, [float("nan")] * 10, 1), (3003, [float("inf")] * 10, 2), (3004, [], 1), (3005, [1.0, 2.0], 1),
             (3006, [0.0] * 10, 2), (3010, [1.0] * 10, None), (None, [1.0] * 10, 1), (20, rows[20][1], 3), (20, [1.0] * 10, 2), (3007, [900.0] * 10, 9)]
    frame = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, F.col("label")).collect())
    assert got == plain(rows, lambda i: i % 10 == 0)


def test_nothing_and_few(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.5, 0.0], 2), (3, [0.95, 0.0], 2)], "vec_id long, embedding array<double>, label int")
    find = lambda df: sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") == 0, F.col("label")).collect())
    assert find(frame) == [(0, 1, 1, 2, 65536, 32768)]
    assert find(frame.limit(0)) == [] and find(frame.filter("vec_id < 2")) == [] and find(frame.filter("vec_id <> 0")) == []


def test_huge_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6) * 1e6], i % 2) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, F.col("label")).collect())
    assert got == plain(rows, lambda i: i % 10 == 0)


def test_siblings_are_left_out():
    """Where rows lie in clusters, most subtrees cannot meet the annulus."""
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(40, 16))
    middles = np.round(400 * middles / np.linalg.norm(middles, axis=1)[:, None]).astype(int)
    rows = np.concatenate([m + rng.integers(-4, 5, (100, 16)) for m in middles])
    square = int((rows**2).sum(axis=1).max())
    tree = gnat.Tree.from_bytes(gnat.Tree.build(np.arange(4000), np.zeros(4000, np.int64), rows, square).to_bytes())
    ask = np.arange(0, 4000, 200)
    one = np.iinfo(np.int64)
    search = gnat.Search(ask, np.zeros(20, np.int64), rows[ask], np.arange(20), np.full(20, one.min), np.full(20, one.max), 5, True, square, True)
    search.search(tree, np.arange(20))
    scores = rows[ask] @ rows.T
    scores[np.arange(20), ask] = one.min
    assert (search.scores == np.sort(scores, axis=1)[:, :-6:-1]).all()
    assert search.scored < 0.5 * 20 * 4000
