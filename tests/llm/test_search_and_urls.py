"""Top-k search, URL rules, WARC archives and lines against plain versions."""

import hashlib
import random

import numpy as np
import pyarrow.fs as fs
import pytest
from brute import url_verdict
from pyspark.sql import functions as F

from chatterlens.llm import line_dedup, topk, url_filter, warc

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow", "a*b.io/": "block"}


def plain_top_k(rows, asked, k):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    made = []
    for q, a in good:
        if asked(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            made += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(made)


@pytest.mark.parametrize("block", [16, 8192])
def test_top_k_with_ties_and_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATES", block)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 1)]) for i in range(160)]
    rows += [(200 + i, rows[3][1]) for i in range(12)]  # ties
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, []), (305, [1.0, 2.0]), (306, [0.0] * 8), (307, [1e6] * 8), (None, [1.0] * 8)]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, id int, v string, asked int")
    got = sorted(tuple(r)[:4] for r in topk.top_k(frame, F.col("vec_id") % 5 == 0, k=4).collect())
    assert got == plain_top_k(rows, lambda q: q % 5 == 0, 4)


def test_top_k_of_few_and_of_nothing(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 512 * 256)]
    assert topk.top_k(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_walk_stops_before_the_end():
    """The bound ends the walk early where one row stands out."""
    rows = np.zeros((5000, 4), np.int64)
    rows[17] = 200
    rows[np.arange(5000) != 17] = np.random.default_rng(2).integers(-3, 4, (4999, 4))
    lists, met = topk.Lists(np.arange(5000), rows), []
    score = lists.score
    lists.score = lambda some, q: (met.append(len(some)), score(some, q))[1]
    ids, scores = lists.best(-1, np.array([5, 5, 5, 5]), 1)
    assert ids.tolist() == [17] and scores.tolist() == [4000] and sum(met) < 500


def test_urls(spark):
    rng = random.Random(1)
    hosts = ["net", "example.net", "a.EXAMPLE.net", "badexample.net", "example.com", "x.org", "org", "net.org", "example.net:80", "u@example.net", "", "axxb.io", "w.ab.io"]
    paths = ["", "/", "/en/", "/en", "/en/a", "/EN/", "/de/x", "/fr/y?z", "?q=/en/", "#/fr/", "/a/net/", "//en/"]
    urls = [None, "", "net/", "http:/net/", "://net/", "a://b://net/", "http://net/" + "p" * 5000, "http://ex ample.net/en/\nx", "http://évil.net/é"]
    urls += [rng.choice(["http", "HTTPS", "ftp"]) + "://" + rng.choice(hosts) + rng.choice(paths) for _ in range(400)]
    pages = spark.createDataFrame([(i, u, "h", "p", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, path string, id int")
    plain = {k: v for k, v in RULES.items() if "*" not in k}
    got = sorted(tuple(r) for r in url_filter.judge_urls(pages, plain).collect())
    assert got == [(i, *url_verdict(u, plain, "allow")) for i, u in enumerate(urls)]
    assert {r["rule"] for r in url_filter.judge_urls(pages, RULES).collect()} >= {"a*b.io/"}
    assert {r["verdict"] for r in url_filter.judge_urls(pages, {}, "block").collect()} == {"block"}
    assert url_filter.judge_urls(pages.limit(0), RULES).count() == 0


def test_many_globs_over_several_words():
    rng = random.Random(2)
    names = ["".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(150)]
    automaton = url_filter.Automaton([f"*.{n}/**" for n in names])
    hosts = ["".join(rng.choices("abc.", k=rng.randint(1, 12))) for _ in range(200)]
    found = automaton.matches([f".{h}/p".encode() for h in hosts])
    assert found.tolist() == [[("." + h).endswith("." + n) for n in names] for h in hosts]


def expected_records(rows, least=1000):
    last = {}
    digest = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    for i, _, h in rows:
        last[digest(h)] = max(last.get(digest(h), -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        again = len((h or "").encode()) >= least and i != last[digest(h)]
        out.append((i, len((h or "").encode()), digest(h), "revisit" if again else "response", last[digest(h)] if again else None))
    return out


def test_warc_round_trip(spark, tmp_path):
    big, other = "é" * 600, "<p>" + "x" * 200_000
    rows = [(1, "http://a", big), (2, "http://b\r\nc", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "tiny"), (7, "u", "tiny"),
            (8, "u", other), (9, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 60), (10, "u", "\x1f\x8b\x08" * 900), (3, "again", big)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, n int")
    got = sorted((tuple(r) for r in warc.round_trip(pages, str(tmp_path / "w")).collect()), key=str)
    assert got == sorted(expected_records(rows), key=str)
    assert warc.round_trip(pages.limit(0), str(tmp_path / "empty")).count() == 0


def test_warc_ranges_filters_and_plain_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " + "y" * (i * 37)) for i in range(300)], "page_id long, url string, html string").coalesce(1)
    folder = str(tmp_path / "w")
    warc.store_pages(pages, folder)
    whole = {r["record_id"]: bytes(r["payload"]) for r in warc.read_warc(spark, folder).collect()}
    assert len(whole) == 300
    split = spark.read.format("warc").option("path", folder).option("split_bytes", "3000").load()
    assert split.rdd.getNumPartitions() > 5 and {r["record_id"]: bytes(r["payload"]) for r in split.collect()} == whole
    one = warc.read_warc(spark, folder).filter("target_uri = 'http://h/7'")
    assert [r["record_id"] for r in one.collect()] == ["urn:x-page:7"]
    assert [r["payload"] for r in warc.read_warc(spark, folder, payload=False).filter("record_id IN ('urn:x-page:1', 'urn:x-page:2')").collect()] == [None, None]
    # A plain archive and one whose members lack the skip-length field.
    import gzip
    row = dict(record_type="response", record_id="urn:x-page:1", target_uri="u", payload_digest=None, refers_to=None, http_length=5, payload=b"hello")
    records = [warc.record(row | {"record_id": f"urn:x-page:{i}"}, "d") for i in range(5)]
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.warc").write_bytes(b"".join(records))
    (other / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    assert warc.read_warc(spark, str(other)).filter("record_id = 'urn:x-page:3'").count() == 2
    assert {bytes(r["payload"]) for r in warc.read_warc(spark, str(other)).collect()} == {b"hello"}


def test_unwanted_records_are_not_inflated(tmp_path, monkeypatch):
    row = dict(record_type="response", record_id="urn:x-page:1", target_uri="u", payload_digest=None, refers_to=None, http_length=10**6, payload=random.Random(1).randbytes(10**6))
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(warc.member(warc.record(row | {"record_type": t}, "d")) for t in ("response", "revisit", "response")))
    read = []
    take = warc.Inflated._read
    monkeypatch.setattr(warc.Inflated, "_read", lambda self, n: (read.append(n), take(self, n))[1])
    with fs.LocalFileSystem().open_input_file(str(path)) as file:
        found = list(warc.records(file, 0, path.stat().st_size, True, lambda h: h["warc-type"] == "revisit", True))
    assert len(found) == 1 and sum(read) <= 3 * warc.FIRST_READ


def plain_lines(rows, least):
    sites, first = {}, {}
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            norm = line.strip(" \t\n\x0b\f\r")
            if norm:
                sites.setdefault(norm, set()).add(s)
                first[norm] = min(first.get(norm, i), i)
    common = {n for n, s in sites.items() if len(s) >= least}
    keep = lambda i, x: x.strip(" \t\n\x0b\f\r") not in common or first[x.strip(" \t\n\x0b\f\r")] == i
    return sorted((i, None if t is None else "\n".join(x for x in t.split("\n") if keep(i, x))) for i, t, _ in rows)


@pytest.mark.parametrize("least", [2, 8, 150])
def test_lines_of_many_sites(spark, least):
    rng = random.Random(least)
    lines = [f"line {k}" for k in range(12)] + ["", "  ", "\tline 3 ", "everywhere"]
    rows = []
    for i in range(500):
        weights = [1 / (k + 1) for k in range(len(lines))]
        rows.append((i, "\n".join(rng.choices(lines, weights, k=rng.randint(0, 5)) + [f"own {i}"]), rng.choice(["hot", f"s{rng.randrange(200)}"])))
    rows += [(900, None, "hot"), (901, "", None), (902, "everywhere", None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, pos int, line string")
    got = line_dedup.without_widespread_lines(docs, least)
    assert got.columns == [*docs.columns, "n_lines_removed"]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect())) == plain_lines(rows, least)


def test_lines_odd_rows(odd_docs, no_docs):
    got = line_dedup.without_widespread_lines(odd_docs, 2)
    assert got.count() == odd_docs.count()
    assert line_dedup.without_widespread_lines(no_docs).count() == 0


def test_names_that_clash(spark):
    rows = [(i, f"common\nown {i}", f"s{i}", 1, 2, 3, 4, 5, 6, 7, 8) for i in range(9)]
    names = "drop int, drop_id int, DROP_key int, first int, line int, pos int, n_lines_removed int, sites int"
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {names}")
    got = line_dedup.without_widespread_lines(docs)
    assert got.columns.count("n_lines_removed") == 1 and set(got.columns) == set(docs.columns)
    assert sorted((r["doc_id"], r["text"], r["drop"], r["n_lines_removed"]) for r in got.collect()) == [(0, "common\nown 0", 1, 0)] + [(i, f"own {i}", 1, 1) for i in range(1, 9)]


def test_plain_archives_with_records_in_payloads(spark, tmp_path):
    row = dict(record_type="response", record_id="urn:x-page:1", target_uri="u", payload_digest=None, refers_to=None, http_length=None)
    inner = warc.record(row | {"record_id": "urn:x-page:777", "http_length": 5, "payload": b"inner"}, "d")
    payloads = [b"x" * 2500 + inner + b"y" * 2500 for _ in range(3)]
    made = [warc.record(row | {"record_id": f"urn:x-page:{i}", "http_length": len(p), "payload": p}, "d") for i, p in enumerate(payloads)]
    (tmp_path / "a.warc").write_bytes(b"".join(made))
    got = spark.read.format("warc").option("path", str(tmp_path)).option("split_bytes", "2000").load().collect()
    assert sorted((r["record_id"], bytes(r["payload"])) for r in got) == [(f"urn:x-page:{i}", p) for i, p in enumerate(payloads)]
