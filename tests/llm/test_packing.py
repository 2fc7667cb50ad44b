"""Packing: exact fills, and every id in exactly one place."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from brute import best_sum
from tokenizers import Tokenizer

from chatterlens.llm import packing

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, rows, window=1024):
    tokenizer = Tokenizer.from_file(BYTES)
    expected = Counter()
    for i, text in rows:
        expected[(i, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids) + (0,))] += 1
    total = sum(len(ids) * n for (_, ids), n in expected.items())
    assert sum(p["length"] for p in pieces) == total
    by_start = Counter((p["doc_id"], p["doc_tokens"], p["start"], p["length"], p["ids_crc32"]) for p in pieces)
    for (doc, tokens, start, length, crc), n in by_start.items():
        fits = [m for (i, ids), m in expected.items() if i == doc and len(ids) == tokens and zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc]
        assert length > 0 and sum(fits) >= n
    for (doc, ids), n in expected.items():  # every id of every row lies in one piece
        assert sum(p["length"] for p in pieces if p["doc_id"] == doc and p["doc_tokens"] == len(ids)) == sum(
            len(o) * m for (i, o), m in expected.items() if i == doc and len(o) == len(ids))
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    sizes = []
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
        sizes.append(at)
    assert sum(window - s for s in sizes) < window  # only one window isn't full
    return sizes


def test_best_fill_is_the_closest(spark):
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 60): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        room = rng.randint(1, 150)
        total, used = packing.best_fill(room, counts)
        assert total == best_sum(room, counts) == sum(k * n for k, n in used.items())
        assert all(n <= counts[k] for k, n in used.items())


def test_plan_uses_every_rest_once():
    rng = random.Random(2)
    histogram = {rng.randint(1, 99): rng.randint(1, 50) for _ in range(40)}
    patterns, over = packing.slack_plan(histogram, 100)
    used = Counter(over)
    for pattern, times in patterns:
        assert sum(k * n for k, n in pattern.items()) == 100
        for k, n in pattern.items():
            used[k] += n * times
    assert used == Counter(histogram)


def test_pack_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(packing.pack(docs, BYTES).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_pack_one_length_only(spark):
    """All rests have one length, for which no exact fill exists: they are cut."""
    docs = spark.createDataFrame([(i, "word " * 299 + "word") for i in range(200)], "doc_id long, text string")
    sizes = check(packing.pack(docs, BYTES).collect(), [tuple(r) for r in docs.collect()])
    assert len(sizes) == -(-200 * 301 // 1024)


def test_pack_odd_rows(odd_docs, no_docs):
    check(packing.pack(odd_docs, BYTES).collect(), [tuple(r) for r in odd_docs.select("doc_id", "text").collect()])
    assert packing.pack(no_docs, BYTES).count() == 0
