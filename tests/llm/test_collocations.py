"""Collocations and their quotient filters against plain counting."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import lower_ascii

from chatterlens.llm import collocations
from chatterlens.llm.quotient import Entries, Layout, entries


@pytest.mark.parametrize("words, bits, shard_bits", [(2, 1, 0), (2, 5, 3), (3, 7, 2), (3, 21, 6), (3, 22, 4), (4, 31, 9), (3, 42, 0), (2, 3, 20)])
def test_filters_lose_nothing(words, bits, shard_bits):
    rng = np.random.default_rng(words * bits)
    layout = Layout(words, bits, shard_bits)
    ids = [rng.integers(0, 1 << bits, 4000) for _ in range(words)]
    ids = [np.concatenate([c, np.repeat(c[:1], 700), c[:500]]) for c in ids]
    high, low = layout.permuted(*layout.pack(ids))
    assert all((a == b).all() for a, b in zip(layout.unpack(*layout.restored(high, low)), ids))
    made = layout.counted(ids)
    read = [entries(layout, shard, raw) for shard, raw in made.filters()]
    assert sum(map(len, read)) == len(made) and len(read) <= 1 << layout.shard_bits
    back = Counter({t: n for e in read for *t, n in zip(*e.ids(), e.counts.tolist()) for t in [tuple(int(x) for x in t)]})
    assert back == Counter(tuple(int(x) for x in t) for t in zip(*ids))
    halves = [layout.counted([c[part] for c in ids]) for part in (slice(0, 2000), slice(2000, None))]
    both = Entries.joined(halves)
    assert all((getattr(both, c) == getattr(made, c)).all() for c in ("high", "low", "counts"))
    assert Entries.joined([made, made]).counts.max() == 2 * made.counts.max()


def test_wide_grams_are_refused():
    with pytest.raises(ValueError):
        Layout(4, 40)


def plain_collocations(rows, max_words, min_count, cover, first):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower_ascii(text or "")):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, max_words + 1):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        made = []
        for p, a in found.items():
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if not any(len(q) > len(p) and inside(q) and 100 * b >= cover * a for q, b in found.items()):
                made.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(made)[:first])]
    return sorted(out)


SCHEMA = "doc_id long, text string, lang string, ids int, phrase string, part int, score string"


@pytest.mark.parametrize("max_words, first", [(2, 2000), (3, 2000), (3, 7), (4, 15)])
def test_collocations_equal_plain_counting(spark, monkeypatch, max_words, first):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(collocations, "HELD_ENTRIES", 500)
    monkeypatch.setattr(collocations, "SHARD_NGRAMS", 200)
    rng = np.random.default_rng(3)
    vocabulary = ["The", "the", "CAT", "Éa", "éa", "日本", "x" * 300, "a-b", "c'd", "\x00", " n", *[f"w{i}" for i in range(30)]]
    marks = [" ", "  ", "\t", ". ", "\n", ", ", " ; ", "\x0b"]
    weights = np.array([20, 1, 1, 1, 1, 1, 0.5, 0.5])
    rows = []
    for i in range(300):
        line = "".join(w + m for w, m in zip(rng.choice(vocabulary, 40, p=None), rng.choice(marks, 40, p=weights / weights.sum())))
        rows.append((["en", "de", None, "und"][i % 4], line + " once upon a time once upon a time" * (i % 5)))
    rows += [("en", None), (None, ""), ("fr", " .;\n"), ("en", "tie one tie two. " * 12), ("en", "a " * 5000), ("", "empty lang here " * 11)]
    docs = spark.createDataFrame([(i, t, g, 1, "p", 2, "s") for i, (g, t) in enumerate(rows)], SCHEMA)
    got = sorted(tuple(r) for r in collocations.collocations(docs, max_words, 10, 50, first).collect())
    assert got == plain_collocations(rows, max_words, 10, 50, first)


def test_tasks_hold_little(monkeypatch):
    """However large a chunk or a shard is, few n-grams are made or held at once, and none is lost where slices meet."""
    monkeypatch.setattr(collocations, "SLICE_PLACES", 100)
    monkeypatch.setattr(collocations, "HELD_ENTRIES", 300)
    made, joined = [], []
    counted, join = Layout.counted, Entries.joined
    monkeypatch.setattr(Layout, "counted", lambda self, ids: made.append(len(ids[0])) or counted(self, ids))
    monkeypatch.setattr(Entries, "joined", staticmethod(lambda parts: joined.append(sum(map(len, parts))) or join(parts)))
    layouts = {m: Layout(m, 9, 2) for m in (2, 3)}
    codes = np.random.default_rng(1).integers(-1, 400, 20_000).astype(np.int32)
    ids = np.arange(400)[::-1]
    chunk = pa.RecordBatch.from_pydict({"codes": [codes.tobytes()], "places": pa.array([np.arange(400, dtype=np.int32)]), "ids": pa.array([ids])})
    sent = [r for b in collocations.filters(iter([chunk, chunk]), layouts) for r in b.to_pylist()]
    assert max(made) <= 100 and max(joined) <= 300 + 100
    line = np.where(codes < 0, -1, ids[codes])
    expected = Counter(tuple(int(x) for x in g) for m in layouts for g in np.lib.stride_tricks.sliding_window_view(line, m) if (g >= 0).all())
    joined.clear()
    batches = [pa.RecordBatch.from_pylist([r], schema=collocations.FILTER) for r in sorted(sent, key=lambda r: (r["size"], r["shard"]))]
    back = {tuple(r["ids"]): r["a"] for b in collocations.merged(iter(batches), layouts, 1) for r in b.to_pylist()}
    assert back == {g: 2 * n for g, n in expected.items()}
    # A shard that stays larger than what is held is not merged again for every filter.
    assert sum(joined) < 6 * sum(len(entries(layouts[r["size"]], r["shard"], r["filter"])) for r in sent)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in collocations.collocations(odd_docs, min_count=2).collect()) == plain_collocations(rows, 3, 2, 50, 2000)
    made = collocations.collocations(no_docs)
    assert made.count() == 0 and dict(made.dtypes)["rank"] == "bigint"
    with pytest.raises(ValueError):
        collocations.collocations(no_docs, max_words=1)
