"""Quality counts and estimates against plain versions; toxicity by held-out accuracy."""

import random
import zlib

import numpy as np
from brute import base_counts, determinant_distances, quality_kept
from pyspark.sql import functions as F

from chatterlens.llm import quality, toxicity


def test_counts_equal_the_definition(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        words = [rng.choice(["a", "é💩", "b#", "*", "x|y", "word", "\xa0", "\x1c"]) for _ in range(rng.randint(0, 60))]
        rows.append((i, "".join(w + rng.choice([" ", "\n", "\t", "\x0b\r", "  \n"]) for w in words)))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "r " * 40), (904, "a b c d e f g h " * 3 + " ".join(map(str, range(200)))), (905, "same\nsame\n\n\nsame")]
    docs = spark.createDataFrame([(*r, "en", "s", 1, "x") for r in rows], "doc_id long, text string, lang string, source string, words int, hashes string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in quality.quality(docs).collect()}
    assert got == {i: base_counts(t) for i, t in rows}


def vectors(spark, x):
    return spark.createDataFrame([(i, 1, *map(float, r)) for i, r in enumerate(x)], "q_id long, stratum long, " + ", ".join(f"{s} double" for s in quality.STATISTICS))


def test_estimates_equal_plain_concentration_steps(spark):
    """The distances against the same steps in numpy, with exact medians and quantiles."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) * 0.4 + 2
    x[:40] += 15
    frame = vectors(spark, x)
    rows = {few: quality.measured(frame, quality.concentrate(frame, 0.75, 100, few), few).orderBy("q_id").collect() for few in (True, False)}
    got = np.array([r["d2"] for r in rows[True]])
    expected = determinant_distances(x, 1e-4 * x.var(axis=0) + 1e-12, 0.75, quality.consistency(0.75))(x)
    assert np.allclose(got, expected, rtol=1e-6) and np.allclose(got, [r["d2"] for r in rows[False]], rtol=1e-6)
    assert (got > 60).sum() >= 40


def test_the_covariance_decides(spark):
    """Rows ordinary in every statistic but against their correlation are far off, and only they."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    x[:, 1] = 0.98 * x[:, 0] + 0.05 * rng.normal(size=600)
    x[:10, 0], x[:10, 1] = 1.2, -1.2
    frame = vectors(spark, x)
    got = np.array([r["d2"] for r in quality.measured(frame, quality.concentrate(frame, 0.75, 100)).orderBy("q_id").collect()])
    assert (got[:10] > quality.CUTOFF).all() and not (got[10:] > quality.CUTOFF).any()
    assert (np.abs(x[:10] - x.mean(axis=0)) < 3 * x.std(axis=0)).all()
    least = [quality.LEAST_SPREAD**2 * v for v in x.var(axis=0)]
    assert all(b < 1e-2 * v for b, v in zip(least, x.var(axis=0)))


def test_kept_equals_plain_strata_pooling_and_estimates(spark):
    rng = random.Random(6)
    word = lambda top: "".join(rng.choices("etaoinshr", k=rng.randint(2, top)))
    rows = []
    for i in range(700):
        lang, source = rng.choice([("en", "hot"), ("en", "hot"), ("en", None), (None, "a"), ("de", f"rare{i % 9}"), ("fr", f"s{i % 3}"), ("it", "x")])
        if lang == "it" and i % 3:
            lang = "es"  # Italian and Spanish are pooled with the other rests
        junk = "#$" * (i % 40 == 7) * rng.randint(1, 4)
        lines = [" ".join(word(9 if lang != "fr" else 13) + rng.choice(["", "", "", ".", ","]) + junk for _ in range(rng.randint(5, 15))) for _ in range(rng.randint(1, 20))]
        rows.append((i, "\n".join(lines), lang, source))
    usual = next(r for r in rows if r[0] % 40 != 7 and 100 < len(r[1].split()) < 200)
    rows += [(1000 + i, *usual[1:]) for i in range(300)]  # copies don't narrow the estimate
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.quality(docs, min_group=50).collect()}
    assert got == quality_kept(rows, 50, 0.75, quality.consistency(0.75), quality.CUTOFF, quality.LEAST_VECTORS)
    assert 5 < sum(not k for k in got.values()) < 150


def test_few_documents_have_no_estimate(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30 + i)), "en", "s") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert [r["kept"] for r in quality.quality(docs.union(docs)).collect()] == [True] * 24


def test_consistency_factor():
    assert abs(quality.chi2_quantile(0.95, 4) - 9.4877) < 1e-3 and 1.4 < quality.consistency(0.75) < 1.6


def test_quality_keeps_ordinary_documents_and_rejects_junk(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randint(2, 9)))
    rows = [(i, "\n".join(" ".join(word() for _ in range(12)) for _ in range(rng.randint(2, 20))), rng.choice(["en", "de"]), rng.choice(["hot", "hot", "a", f"rare{i}"])) for i in range(400)]
    rows += [(1000 + i, " ".join(word() + "###$$$***" for _ in range(100)), "en", "hot") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(docs).collect()}
    assert all(kept[i] for i in range(400)) and not any(kept[1000 + i] for i in range(20))


def test_each_kind_of_repetition_rejects_by_itself(spark):
    """Documents like the others but for repeated lines only, or for repeated words only (below the base rule's 30 %)."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, "\n".join(line(12) for _ in range(20))) for i in range(300)]
    rows += [(1000 + i, "\n".join(f"{line(12)}\nsome line here" for _ in range(20))) for i in range(5)]
    for i in range(5):
        copied = line(34)
        rows.append((2000 + i, f"{line(90)} {copied} {line(80)} {copied}"))
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    lines, words = [got[1000 + i] for i in range(5)], [got[2000 + i] for i in range(5)]
    assert all(r["n_dup_lines"] == 19 and r["n_repeat_words"] == 0 and not r["base_failed"] for r in lines)
    assert all(r["n_dup_lines"] == 0 and r["n_repeat_words"] == 68 and not r["base_failed"] for r in words)
    assert not any(r["kept"] for r in lines + words) and all(got[i]["kept"] for i in range(300))


def test_quality_odd_rows(odd_docs, no_docs):
    rows = quality.quality(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["kept"] in (True, False) for r in rows)
    assert sorted(str((r["doc_id"], r["n_words"])) for r in rows) == sorted(str((r["doc_id"], base_counts(r["text"])[0])) for r in odd_docs.collect())
    assert quality.quality(no_docs).count() == 0


def test_native_plan(odd_docs):
    plan = quality.counts(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def insults(seed, n):
    rng = random.Random(seed)
    common = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 6))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(common) if rng.random() < 0.8 else "".join(rng.choices("abcdefgh", k=8)) for _ in range(rng.randint(20, 400))]
        bad = i % 6 == 0
        for _ in range(4 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty,", "Rotten", "foul."]))
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = insults(1, 900)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    given = spark.createDataFrame(labels + [(5, 1, None), (10**6, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(frame, given).collect()
    assert len(rows) == 900
    right = 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        right += r["held_out"] and r["predicted"] == int(r["doc_id"] % 6 == 0)
    assert right >= 0.97 * sum(r["held_out"] for r in rows)
    # Held-out labels and the other columns change nothing.
    flipped = given.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = frame.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).withColumn("label", F.lit("z"))
    again = toxicity.score_toxicity(other, flipped).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, 1, 0), (7, 1, 0), (9, 1, 1), (None, 1, 1), (1, 1, 7)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(no_docs, labels).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(odd_docs, labels.limit(0)).collect()} == {0.0}
    assert {r["predicted"] for r in toxicity.score_toxicity(odd_docs, labels.filter("toxic = 1")).collect()} <= {0, 1}


def test_log_likelihoods_equal_the_definition(spark):
    """Word and pair ratios against plain counts of strings; the shared counts are exact to a map's collisions."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary[: 40 if i % 3 else 12]) for _ in range(rng.randint(0, 30))]
        rows.append((" ".join(words).upper() + "!", i % 3 == 0))
    rows += [(f"rare{i} w1, W2", False) for i in range(30)]
    frame = spark.createDataFrame([(t, int(k)) for t, k in rows], "text string, label int")
    extra = spark.createDataFrame([(f"other{i} w3",) for i in range(25)], "text string")
    model = toxicity.trained(frame.select("text").union(extra), frame)

    split = lambda t: t.lower().replace("!", " ").replace(",", " ").split()
    pairs_of = lambda t: set(zip([None, *split(t)], split(t)))
    counts = [{}, {}]
    for text, k in rows:
        for pair in pairs_of(text):
            counts[k][pair] = counts[k].get(pair, 0) + 1
    everywhere = set().union(*(pairs_of(t) for t, _ in rows), *(pairs_of(f"other{i} w3") for i in range(25)))
    number = lambda word: toxicity.word_hashes([word])[2] if word else np.zeros(1, np.uint64)
    table = model.words
    lefts = toxicity.shared_counts(frame.select("text").union(extra), table)
    d = toxicity.DISCOUNT
    n = [{w: sum(1 for p in c if p[1] == w) for w in {p[1] for p in c}} for c in counts]
    free = [sum(min(x, d) for x in n[k].values()) / len(counts[k]) for k in (0, 1)]
    held = 0
    for v, w in everywhere:
        at = int(table.find(number(w))[0])
        base = (lefts[at] + 0.5) / (lefts.sum() + 0.5 * len(lefts))
        chance, joint = [], []
        for k in (0, 1):
            chance.append(max(n[k].get(w, 0) - d, 0) / len(counts[k]) + free[k] * base)
            seen = [c for p, c in counts[k].items() if p[0] == v]
            back = sum(min(c, d) for c in seen) / sum(seen) if seen else 1.0
            joint.append((max(counts[k].get((v, w), 0) - d, 0) / sum(seen) if seen else 0.0) + back * chance[k])
        offset = np.log(free[1] / free[0])
        place = int(model.pairs.find(toxicity.pair_hash(number(v), number(w)))[0])
        got = model.pair[place]
        held += not np.isnan(got)
        if np.isnan(got):
            got = model.context[int(table.find(number(v))[0])] + model.word[at]
        if at < len(table.keys):
            assert abs(model.word[at] - (np.log(chance[1] / chance[0]) - offset)) < 1e-9
            true = sum(1 for p in everywhere if p[1] == w)
            assert abs(lefts[at] - true) <= 2 + 0.35 * true
        assert abs(got - (np.log(joint[1] / joint[0]) - offset)) < 1e-9
    assert 20 < held < len(everywhere) and any(w is not None and table.find(number(w))[0] == len(table.keys) for _, w in everywhere)


def test_distinct_counts_of_all_sizes():
    rng = np.random.default_rng(5)
    for true in (1, 10, 100, 3000, 100_000, 2_000_000):
        hashed = toxicity.mixed(rng.integers(0, 1 << 62, true, dtype=np.uint64))
        level = np.minimum((64 - np.frexp((hashed >> np.uint64(6)).astype(float))[1] - 6) // 2, toxicity.LEVELS - 1)
        bits = np.array([[len(np.unique(hashed[level == i] & np.uint64(63))) for i in range(toxicity.LEVELS)]])
        assert abs(toxicity.distinct(bits)[0] - true) <= 1 + 0.4 * true
    words = toxicity.word_hashes(["A b\tc", "", "b!", "x" * 100_000 + " y"])
    assert words[0].tolist() == [0, 0, 0, 2, 3, 3] and words[1][[0, 3, 4]].tolist() == [0, 0, 0]
    assert words[2][1] == words[2][3] and len(set(words[2].tolist())) == 5
