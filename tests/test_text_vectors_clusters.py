"""Text enrichment, vector search, clustering and scores."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatterlens import schemas
from chatterlens.functions import fixed_values as fv
from chatterlens.functions.matching import words_in
from chatterlens.operators import clusters as cl
from chatterlens.operators import enrich as en
from chatterlens.operators import ivf
from chatterlens.operators import vectors as ve


def texts(spark, *contents):
    return spark.createDataFrame([(f"m{i}", c) for i, c in enumerate(contents)], "id string, content string")


def test_words_are_substrings(spark):
    df = texts(spark, "INTEREST in restful APIs", "", None)
    rows = [r.w for r in df.select(words_in("content", ["rest", "api", "interest", "zzz"]).alias("w")).collect()]
    assert rows == [["api", "interest", "rest"], [], None]
    lists = [sorted({*fv.TOOL_WORDS, *fv.PAIN_WORDS}), fv.INTEGRATION_WORDS, ["a", "aa", "aba", "ba", "a.c", "(x", "é"]]
    contents = ["I can't log in, the custom domain SSL certificate failed; wont deploy", "testing auth0 authentication", "abaaba a.c abc (x é" * 3, "aaaa"]
    for words in lists:
        found = [r.w for r in texts(spark, *contents).select(words_in("content", words).alias("w")).collect()]
        assert found == [sorted({w for w in words if w in c.lower()}) for c in contents]


def test_tools_and_pains_count_twice(spark):
    row = en.extract_tools_and_pains(texts(spark, "Export via webhook")).first()
    assert row.tools == ["export", "webhook"] and row.pain_points == ["export", "webhook"] and len(row.all) == 4


def test_auto_categories(spark):
    rows = en.auto_categories(en.extract_keywords(texts(spark, "migrating off stripe", "hello"))).collect()
    assert rows[0].auto_categories == ["migration_export", "payment"] and rows[1].auto_categories == ["uncategorized"]


def test_rules(spark):
    cases = {
        "Twelve dollars a seat is overpriced and the plan went up again": "pricing_complaints", "Single sign-on with SAML, how does the login work here?": "authentication_needs",
        "I wish there were a calendar view": "feature_requests", "The upload is broken since Tuesday, an error every time": "bug_reports",
        "I find the new menu confusing": "usability_problems", "Please connect this with our Slack webhook": "integration_requests",
        "We want to customize the colours of the header": "customization_requests", "Pages are slow after lunch": "performance_issues",
        "Where are the invoices?": "questions", "free nitro at discord.gg/xyz": "spam_noise", "good morning all": "questions",
    }
    out = [r.category for r in en.classify_by_rules(texts(spark, *cases)).collect()]
    assert out == list(cases.values())


def test_failing_providers(spark):
    df = texts(spark, *["text"] * 25).repartition(1)

    def broken(batch):
        raise RuntimeError("no service")

    rows = en.embed_messages(df, broken, batch_size=10).collect()
    assert len(rows) == 25 and {r.status for r in rows} == {"failed"} and all(r.embedding is None for r in rows)
    assert en.classify_messages(df, broken, batch_size=10).count() == 0
    vectors = {r.message_id: list(r.embedding) for r in en.embed_hashed(texts(spark, "Two words", "two  WORDS", "", None, "words"), 32).collect()}
    assert vectors["m0"] == vectors["m1"] and abs(sum(x * x for x in vectors["m0"]) - 1) < 1e-5 and not any(vectors["m2"] + vectors["m3"])
    assert en.embed_texts(spark, ["words", "two words"], 32) == [vectors["m4"], vectors["m0"]]


def test_small_batches_share_a_frame(monkeypatch):
    calls = []

    def provider(batch):
        calls.append(len(batch))
        if "t7" in batch:
            raise RuntimeError("no service")
        return [[float(len(t)), 1.0] for t in batch]

    frames = [pd.DataFrame({"id": [f"m{i}" for i in part], "content": [f"t{i}" for i in part]}) for part in (range(0, 40), range(40, 90), range(0))]
    made = list(en._embedded(iter(frames), provider, 1, 2, 0.0))
    assert len(made) == 1 and calls == [1] * 91
    assert made[0]["message_id"].tolist() == [f"m{i}" for i in range(90)]
    assert [i for i, s in enumerate(made[0]["status"]) if s == "failed"] == [7] and made[0]["embedding"][7] is None
    assert made[0]["embedding"][89] == [3.0, 1.0]
    # Long vectors leave after as many numbers as are allowed, and a batch never crosses two incoming frames.
    calls.clear()
    monkeypatch.setattr(en, "FRAME_VALUES", 60)
    assert [len(f) for f in en._embedded(iter(frames), provider, 25, 1, 0.0)] == [65, 25] and calls == [25, 15, 25, 25]
    monkeypatch.setattr(en, "FRAME_VALUES", 50)
    assert [len(f) for f in en._embedded(iter(frames), lambda b: [[1.0, 2.0]] * len(b), 25, 1, 0.0)] == [25, 40, 25]
    with pytest.raises(ValueError):
        list(en._embedded(iter(frames), lambda b: [[1.0]], 25, 1, 0.0))


def test_responses(spark):
    df = spark.createDataFrame([('{"a": "questions", "b": "weird"}',), ("{}",), ('{"c": ',), ("nonsense",)], "response string")
    assert {tuple(r) for r in en.parse_classifications(df).collect()} == {("a", "questions", True), ("b", "weird", False)}


def test_payload_batches_are_bounded(spark):
    df = spark.range(0, 1000).select(F.concat(F.lit("m"), "id").alias("id"), F.lit('say "hi"\nnow').alias("content"))
    rows = en.classification_payload(df, batch_size=30, bucket_rows=200).collect()
    assert max(r.n for r in rows) <= 30 and sum(r.n for r in rows) == 1000
    assert rows[0].payload.split("\n")[0].endswith('say \\"hi\\" now"')


def test_eligibility(spark):
    long = "x" * 30
    df = spark.createDataFrame([
        ("a", "discord", long, '{"type": 0}'), ("reply", "discord", long, '{"type": 19}'), ("bot", "discord", long, '{"author": {"bot": true}}'),
        ("short", "discord", "  " + "x" * 10 + " " * 20, None), ("none", "discord", long, None),
        ("r", "reddit", long, '{"author": "ann"}'), ("rb", "reddit", long, '{"author": "Robotfan"}'),
    ], "id string, platform string, content string, metadata string")
    assert [r.id for r in en.embedding_eligible(df).collect()] == ["a", "none", "r"]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [
        ("v0", [1.0, 0.0], "discord", "s", 10, "u", "alpha"), ("v1", [0.9, 0.1], "discord", "s", 20, "u", "beta"),
        ("v2", [0.0, 1.0], "reddit", "s", 30, "u", "alpha two"), ("v3", [0.1, 0.9], "reddit", "s", 40, "u", "gamma"),
        ("v4", [-1.0, 0.0], "reddit", "s", 50, "u", "delta"), ("v5", [0.9, 0.1], "discord", "s", 60, "u", "twin"),
    ]
    return spark.createDataFrame(rows, schemas.VECTORS)


def test_search(vectors):
    q = {"q": [1.0, 0.0]}
    out = ve.vector_search(vectors, q, 3).collect()
    assert [(r.rank, r.message_id) for r in out] == [(1, "v0"), (2, "v1"), (3, "v5")]
    assert abs(out[1].distance - 0.02) < 1e-6 and out[0].content_preview == "alpha"
    assert [r.message_id for r in ve.similar_to_message(vectors, "v1", 2).collect()] == ["v5", "v0"]
    assert [r.message_id for r in ve.search_by_platform(vectors, q, "reddit", 2).collect()] == ["v3", "v2"]
    assert [r.message_id for r in ve.search_by_timerange(vectors, q, 20, 40, 1).collect()] == ["v1"]
    assert [r.message_id for r in ve.search_filtered(vectors, q, F.lit(True), "alpha").collect()] == ["v0", "v2"]
    with pytest.raises(KeyError):
        ve.similar_to_message(vectors, "absent")
    with pytest.raises(Exception, match="dimensions"):
        ve.vector_search(vectors, {"q": [1.0, 0.0, 0.0]}, 1).collect()


def test_search_merges_tasks(spark, tmp_path):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(5000, 8)).astype("float32")
    df = spark.createDataFrame([(f"p{i:05d}", p.tolist()) for i, p in enumerate(points)], "message_id string, embedding array<float>").repartition(7)
    queries = {f"q{i}": points[i].tolist() for i in range(3)}
    out = {}
    for r in ve.vector_search(df, queries, 12).collect():
        out.setdefault(r.query_id, []).append(r.message_id)
    for i in range(3):
        d = ((points.astype("float64") - points[i].astype("float64")) ** 2).sum(axis=1)
        assert out[f"q{i}"] == [f"p{j:05d}" for j in np.argsort(d, kind="stable")[:12]]
    index = ivf.build_inverted_file(df, str(tmp_path), pivots=9)
    near = ivf.vector_search_approx(index, df, queries, 12).collect()
    assert {(r.query_id, r["rank"], r.message_id) for r in near} == {(q, i + 1, m) for q, ids in out.items() for i, m in enumerate(ids)}


def test_inverted_file_reads_few_rows_of_clustered_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "SLICE_ROWS", 100)
    rng = np.random.default_rng(0)
    middles = rng.normal(size=(20, 12)) * 10
    points = np.concatenate([np.concatenate([m + rng.normal(size=(90, 12)) for m in middles]), np.repeat(middles[:1], 700, axis=0)])
    df = spark.createDataFrame([(f"p{i:05d}", p.tolist()) for i, p in enumerate(points)], "message_id string, embedding array<double>").repartition(5)
    queries = df.filter("int(substring(message_id, 2)) % 50 = 0").select(F.col("message_id").alias("query_id"), "embedding")
    index = ivf.build_inverted_file(df, str(tmp_path), pivots=25)
    assert sum(n for n, _ in index.cells.values()) == len(points)
    got = {}
    for r in ivf.search_inverted(index, queries, 10, probes=3).collect():
        got.setdefault(r.query_id, []).append(r)
    assert len(got) == len(points) / 50
    hits = 0
    for q, rows in got.items():
        d = np.round(((points - points[int(q[1:])]) ** 2).sum(axis=1), 9)
        hits += len({f"p{j:05d}" for j in np.lexsort((np.arange(len(d)), d))[:10]} & {r.message_id for r in rows})
        assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, 11))
    assert hits >= 0.9 * 10 * len(got)
    assert sum(r[0].codes_read for r in got.values() if int(r[0].query_id[1:]) < 1800 and int(r[0].query_id[1:]) >= 90) < 0.2 * 34 * len(points)
    few = ivf.build_inverted_file(df.limit(3), str(tmp_path / "few"))
    assert ivf.search_inverted(few, queries.limit(1), 10).count() == 3
    with pytest.raises(ValueError):
        ivf.build_inverted_file(df.limit(0), str(tmp_path / "none"))


def test_vector_writes(spark, vectors):
    more = spark.createDataFrame([("v0", [5.0, 5.0]), ("v9", [1.0, 1.0])], "message_id string, embedding array<float>")
    grown = ve.add_vectors(vectors, more, 2)
    assert grown.count() == 7 and grown.filter("message_id = 'v0'").first().embedding == [1.0, 0.0]
    bad = spark.createDataFrame([("v8", [1.0])], "message_id string, embedding array<float>")
    with pytest.raises(Exception, match="wrong vector length"):
        ve.add_vectors(vectors, bad, 2).collect()
    ids = spark.createDataFrame([("v0",), ("zz",)], "id string")
    assert [r.id for r in ve.missing_vector_ids(vectors, ids).collect()] == ["zz"]
    assert ve.delete_vectors(vectors, ids).count() == 5 and ve.reset_vectors(vectors).count() == 0
    assert ve.vector_exists(vectors, "v4").first()[0] and not ve.vector_exists(vectors, "zz").first()[0]
    assert tuple(ve.vector_stats(vectors).first()) == (6, 2)


def blobs(spark, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, 12))
    rows = []
    for c, size in enumerate((260, 150, 80)):
        rows += [(f"b{c}_{i}", (centres[c] + rng.normal(size=12) * 0.05).tolist()) for i in range(size)]
    rows += [(f"n_{i}", rng.normal(size=12).tolist()) for i in range(60)]
    rows += [(f"same_{i}", [1.0] * 12) for i in range(250)]  # a third of all rows are copies
    return spark.createDataFrame(rows, "message_id string, embedding array<double>")


def test_kmeans_wants_enough_vectors(spark):
    few = spark.createDataFrame([(f"m{i}", [float(i % 2), 1.0]) for i in range(30)], "message_id string, embedding array<double>")
    with pytest.raises(ValueError, match="30 clusters"):
        cl.cluster_kmeans(few, 30)
    with pytest.raises(ValueError, match="two clusters"):
        cl.cluster_kmeans(few, 1)
    assert {r.cluster_id for r in cl.cluster_kmeans(few, 2, n_init=1)[0].collect()} == {0, 1}


def test_kmeans_and_scores(spark):
    v = blobs(spark)
    again, first = cl.cluster_kmeans(v, 4, n_init=2)[1], cl.cluster_kmeans(v, 4, n_init=2)[1]
    # Tasks finish in any order, so the sum behind the inertia may differ in its last digit.
    assert again == pytest.approx(first, rel=1e-12)
    scores = cl.compare_k_values(v, ks=(2, 4, 8), n_init=2).collect()
    inertia = [r.inertia for r in scores]
    assert inertia == sorted(inertia, reverse=True)
    assert cl.cluster_kmeans(v, 5, n_init=1)[0].count() == 800


def plain_kmeans(rows, centres, rounds):
    for _ in range(rounds):
        at = ((rows[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([rows[at == j].mean(axis=0) if (at == j).any() else centres[j] for j in range(len(centres))])
    at = ((rows[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    return at, ((rows - centres[at]) ** 2).sum()


def test_groups_share_rounds(spark, monkeypatch):
    """Fits of several groups, ks and starts equal plain k-means from the same starts, with one scan per round."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    group = np.array(["a", "b", "b", "c"])[np.arange(400) % 4]
    points = spark.createDataFrame([(str(g), f"m{i:04d}", v.tolist()) for i, (g, v) in enumerate(zip(group, x))], "group string, message_id string, features array<double>").repartition(3)
    starts, rounds = {}, []
    spread, each = cl._spread_centres, cl._round
    monkeypatch.setattr(cl, "_spread_centres", lambda rows, k, seed: starts.setdefault((len(rows), k, seed), spread(rows, k, seed)))
    monkeypatch.setattr(cl, "_round", lambda p, fits: (rounds.append(len(fits)), each(p, fits)))
    ks = {"a": [2, 5], "b": [3], "c": [4]}
    best = cl.grouped_kmeans(points, ks, 7, 3, 6)
    assert len(rounds) <= 6 and set(rounds) == {12}
    labels = {}
    for r in cl._labels(points, best).collect():
        labels.setdefault((r.group, r.k), {})[r.message_id] = r.cluster_id
    for g, many in ks.items():
        rows = x[group == g]
        for k in many:
            plain = [plain_kmeans(rows, starts[len(rows), k, 7 + s], 5) for s in range(3)]
            at, cost = min(plain, key=lambda p: p[1])
            assert best[g, k].cost == pytest.approx(cost, rel=1e-6)
            ids = [f"m{i:04d}" for i in np.flatnonzero(group == g)]
            assert [labels[g, k][i] for i in ids] == at.tolist()


def test_scores_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 5))
    labels = np.arange(90) % 4 - 1  # -1 is noise
    df = spark.createDataFrame([(f"m{i}", x[i].tolist(), int(labels[i])) for i in range(90)], "message_id string, embedding array<double>, cluster_id int")
    u = x[labels >= 0] / np.linalg.norm(x[labels >= 0], axis=1, keepdims=True)
    y = labels[labels >= 0]
    centres = np.array([u[y == c].mean(axis=0) for c in range(3)])
    within = sum(((u[y == c] - centres[c]) ** 2).sum() for c in range(3))
    between = sum((y == c).sum() * ((centres[c] - u.mean(axis=0)) ** 2).sum() for c in range(3))
    assert abs(cl.calinski_harabasz(df).first()[0] - (between / 2) / (within / (len(u) - 3))) < 1e-9
    spread = np.array([np.linalg.norm(u[y == c] - centres[c], axis=1).mean() for c in range(3)])
    worst = [max((spread[i] + spread[j]) / np.linalg.norm(centres[i] - centres[j]) for j in range(3) if j != i) for i in range(3)]
    assert abs(cl.davies_bouldin(df).first()[0] - np.mean(worst)) < 1e-9
    for metric, gap in (("squaredEuclidean", ((u[:, None] - u[None]) ** 2).sum(axis=2)), ("cosine", 1 - u @ u.T)):
        s = []
        for i in range(len(u)):
            own = (y == y[i]) & (np.arange(len(u)) != i)
            a, b = gap[i][own].mean(), min(gap[i][y == c].mean() for c in range(3) if c != y[i])
            s.append((b - a) / max(a, b))
        assert abs(cl.silhouette(df, metric).first()[0] - np.mean(s)) < 1e-6
    assert tuple(cl.cluster_totals(df).first()) == (3, int((labels == -1).sum()), 90)


def test_degenerate_inputs(spark):
    one = spark.createDataFrame([("a", [1.0, 0.0], 0), ("b", [1.0, 0.0], 0)], "message_id string, embedding array<double>, cluster_id int")
    assert cl.calinski_harabasz(one).first()[0] is None and cl.davies_bouldin(one).first()[0] is None
    none = one.filter("message_id = 'z'")
    assert tuple(en.embedding_cost_estimate(texts(spark, "x").filter("id = 'z'")).first()) == (0, 0, 0.0)
    assert cl.cluster_within_category(none, spark.createDataFrame([], schemas.MESSAGE_TAXONOMY), ["questions"]).count() == 0
    labels = spark.createDataFrame([(1, "a", "questions", 0)], schemas.MESSAGE_TAXONOMY)
    assert cl.cluster_within_category(one, labels, ["questions", "bug_reports"], k=2, n_init=1).count() == 1
