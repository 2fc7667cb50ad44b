"""Phrases whose words stand together more often than their parts would, counted without loss by quotient filters.

1. Texts are cut into words once. Every chunk of some megabytes of one language is written as its distinct words, their
   counts and the places' codes into them, with a mark between pieces.
2. Word counts add up over the chunks. Words of at least ``min_count`` occurrences get dense ids per language (no phrase
   is more frequent than its words); the chunks get the ids by a join on their distinct words, so the dictionary is
   never held whole by anyone.
3. Every chunk's n-grams, made some places at a time, go into counting quotient filters (``quotient``), one per length
   and shard. The permutation spreads the n-grams evenly over the shards, whatever their frequency, and the number of
   shards follows the number of words, so a shard's merged filter stays small. Filters of a shard merge in one task, and
   frequent n-grams come back.
4. Parts are looked up, scores are exact decimals, and only phrases that can be among the first of their language are
   spelled out.

Defined results: a null text is empty; a null language is ``und``; repeated rows and ids count each; an empty table gives
no rows; words of any length take part; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlens.llm.base import BATCH_BYTES, small_batches, written
from chatterlens.llm.quotient import Entries, Layout, entries
from chatterlens.llm.words import Words, byte_class, lowered

CHUNK_BYTES = 8 << 20  # text of a chunk; a longer text is a chunk of its own
SLICE_PLACES = 1 << 18  # places of a chunk whose n-grams are made at once
HELD_ENTRIES = 1 << 20  # n-grams a task holds before it sends its filters
SHARD_NGRAMS = 1 << 20  # n-grams, copies counted, that a shard holds on average at most
BUCKET_WORDS = 50_000  # words that one task numbers
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BETWEEN_WORDS = b" \t"

INSIDE = ~byte_class(PIECE_ENDS + BETWEEN_WORDS)
ENDS = byte_class(PIECE_ENDS)
CHUNK = "chunk long, lang string, words array<string>, counts array<long>, codes binary"


def _chunk(number: int, lang: str, texts: list[bytes]) -> dict:
    """Distinct words, counts and codes (-1 between pieces) of some texts of one language."""
    raw = lowered(b"\n".join(texts))
    words = Words(raw, INSIDE)
    found = words.array.dictionary_encode()
    codes = found.indices.to_numpy().astype(np.int32)
    breaks = np.flatnonzero(np.diff(np.searchsorted(np.flatnonzero(ENDS[raw]), words.starts))) + 1
    return {
        "chunk": number, "lang": lang, "words": found.dictionary.cast(pa.large_string()),
        "counts": np.bincount(codes, minlength=len(found.dictionary)), "codes": np.insert(codes, breaks, -1).tobytes(),
    }


def _batch(rows: list[dict]) -> pa.RecordBatch:
    def lists(name: str, kind: pa.DataType) -> pa.Array:
        offsets = np.cumsum([0, *(len(r[name]) for r in rows)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays([pa.array(r[name]).cast(kind) for r in rows]))

    return pa.RecordBatch.from_arrays(
        [pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([r["lang"] for r in rows], pa.string()), lists("words", pa.string()),
         lists("counts", pa.int64()), pa.array([r["codes"] for r in rows], pa.binary())],
        names=["chunk", "lang", "words", "counts", "codes"])


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the rows (lang, text)."""
    number = TaskContext.get().partitionId() << 32
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang, text in zip(langs, batch.column(1).cast(pa.binary()).to_pylist()):
            held.setdefault(lang, []).append(text)
            size += len(text)
        if size >= CHUNK_BYTES:
            for lang, texts in held.items():
                yield _batch([_chunk(number, lang, texts)])
                number += 1
            held, size = {}, 0
    for lang, texts in held.items():
        yield _batch([_chunk(number, lang, texts)])
        number += 1


def dictionary(chunks: DataFrame, min_count: int) -> DataFrame:
    """(lang, word, f, id) of the frequent words, with nearly dense ids."""
    counts = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word"))
    frequent = written(counts.agg(F.sum("w.counts").alias("f")).filter(F.col("f") >= min_count), "frequent-words")
    buckets = max(64, -(-frequent.count() // BUCKET_WORDS))
    bucket = F.pmod(F.xxhash64("word", "lang"), F.lit(buckets))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("word", "lang")) - 1
    return written(frequent.withColumn("bucket", bucket).select("lang", "word", "f", (place * buckets + F.col("bucket")).alias("id")), "dictionary")


def _layouts(bits: int, max_words: int, shard_bits: int) -> dict[int, Layout]:
    return {m: Layout(m, bits, shard_bits) for m in range(2, max_words + 1)}


def _ngrams(line: np.ndarray, layout: Layout) -> Iterator[Entries]:
    """The counted n-grams of a chunk's ids (negative where none may stand), some places at a time."""
    m = layout.words
    for begin in range(0, len(line) - m + 1, SLICE_PLACES):
        part = line[begin : begin + SLICE_PLACES + m - 1]
        run = part >= 0
        starts = np.flatnonzero(np.logical_and.reduce([run[i : len(run) - m + 1 + i] for i in range(m)]))
        if len(starts):
            yield layout.counted([part[starts + i] for i in range(m)])


def filters(batches: Iterator[pa.RecordBatch], layouts: dict[int, Layout]) -> Iterator[pa.RecordBatch]:
    """Filters of the n-grams of chunks (codes, places, ids); what is held at once follows ``HELD_ENTRIES`` alone."""
    held: dict[int, list[Entries]] = {m: [] for m in layouts}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        rows, volume = [], 0
        for m, parts in held.items():
            for shard, raw in Entries.joined(parts).filters() if parts else ():
                rows.append({"size": m, "shard": shard, "filter": raw})
                volume += len(raw)
                if volume > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=FILTER)
                    rows, volume = [], 0
            held[m] = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=FILTER)

    for batch in batches:
        for codes, places, ids in zip(*(batch.column(c) for c in ("codes", "places", "ids"))):
            codes = np.frombuffer(codes.as_buffer(), np.int32)
            # One more cell, for the mark between pieces, which is code -1.
            table = np.full(int(codes.max()) + 2, -1, np.int64)
            table[places.values.to_numpy()] = ids.values.to_numpy()
            line = table[codes]
            for m, layout in layouts.items():
                for found in _ngrams(line, layout):
                    held[m].append(found)
                    size += len(found)
                    if size > HELD_ENTRIES:
                        yield from sent()
                        size = 0
    yield from sent()


def merged(batches: Iterator[pa.RecordBatch], layouts: dict[int, Layout], min_count: int) -> Iterator[pa.RecordBatch]:
    """The frequent n-grams of filters (size, shard, filter) in the order of their shards."""
    at, parts, settled = None, [], 0

    def done() -> Iterator[pa.RecordBatch]:
        kept = Entries.joined(parts).at_least(min_count) if parts else ()
        for start in range(0, len(kept), 1 << 17):
            some = Entries(kept.layout, *(c[start : start + (1 << 17)] for c in (kept.high, kept.low, kept.counts)))
            flat = np.stack(some.ids(), axis=1)
            offsets = np.arange(len(some) + 1, dtype=np.int32) * flat.shape[1]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel())), pa.array(some.counts)], names=["ids", "a"])

    for batch in batches:
        for m, shard, raw in zip(*(batch.column(c).to_pylist() for c in ("size", "shard", "filter"))):
            if at != (m, shard):
                yield from done()
                at, parts, settled = (m, shard), [], 0
            parts.append(entries(layouts[m], shard, raw))
            # What is merged already is merged again only once as much has come.
            if sum(map(len, parts)) > max(HELD_ENTRIES, 2 * settled):
                parts = [Entries.joined(parts)]
                settled = len(parts[0])
    yield from done()


def counted_phrases(chunks: DataFrame, words: DataFrame, max_words: int, min_count: int) -> DataFrame:
    """(ids, a) of all n-grams of 2 to ``max_words`` frequent words with at least ``min_count`` occurrences."""
    size = chunks.agg(F.sum(F.length("codes")) / 4).first()[0] or 0
    bits = max(1, int(words.agg(F.max("id")).first()[0] or 0).bit_length())
    layouts = _layouts(bits, max_words, max(0, int(size) // SHARD_NGRAMS).bit_length())
    places = chunks.select("chunk", "lang", F.posexplode("words").alias("place", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    ids = places.groupBy("chunk").agg(F.collect_list("place").alias("places"), F.collect_list("id").alias("ids"))

    coded = chunks.select("chunk", "codes").join(ids, "chunk").select("codes", "places", "ids")
    made = coded.mapInArrow(lambda batches: filters(batches, layouts), "size int, shard long, filter binary")
    return made.repartition("size", "shard").sortWithinPartitions("size", "shard").mapInArrow(lambda batches: merged(batches, layouts, min_count), "ids array<long>, a long")


FILTER = pa.schema([("size", pa.int32()), ("shard", pa.int64()), ("filter", pa.binary())])


def _exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right)); the products are decimals of up to 38 digits."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    square = (whole(a, 16) * whole(a, 16)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", square, whole(left, 16) * whole(right, 16))


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, cover_percent: int = 50, first: int = 2000,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    ``a`` is the phrase's count, ``l`` and ``r`` the counts of its two parts at the cut with the lowest score, ``n`` all
    words of the language. A phrase goes if a longer candidate that holds it has at least ``cover_percent`` of its count.
    """
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases have at least two words and one occurrence")
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    chunks = written(rows.mapInArrow(encoded, CHUNK), "chunks")
    words = dictionary(chunks, min_count)
    phrases = written(counted_phrases(chunks, words, max_words, min_count), "phrases")

    counts = phrases.select(F.col("ids").alias("part"), F.col("a").alias("f")).unionByName(words.select(F.array("id").alias("part"), "f"))
    cuts = phrases.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("right"))
    sided = cuts.join(counts.select(F.col("part").alias("left"), F.col("f").alias("l")), "left").join(counts.select(F.col("part").alias("right"), F.col("f").alias("r")), "right")
    best = sided.groupBy("ids", "a").agg(F.min(F.struct(_exact_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("b"))

    size = F.size("ids")
    lengths = F.sequence(F.lit(2), size - 1)
    inner = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("ids", i, m))))
    covers = phrases.filter(size > 2).select(F.explode(inner).alias("ids"), F.col("a").alias("longer")).groupBy("ids").agg(F.max("longer").alias("longer"))
    kept = best.join(covers, "ids", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("a")))
    spelled = words.select(F.col("id").alias("head"), "lang")
    scored = written(kept.select("ids", "a", "b.score", "b.l", "b.r", F.col("ids")[0].alias("head")).join(spelled, "head").drop("head"), "scored")

    # The bound below which no phrase can be among the first; only what reaches it is spelled out.
    order = [F.desc("score"), F.desc("a")]
    bound = _first(scored.select("lang", "score", "a", "ids"), order, first).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("least"))
    reached = scored.join(bound, "lang").filter(F.struct("score", "a") >= F.col("least")).drop("least")
    letters = reached.select("ids", F.posexplode("ids").alias("place", "id")).join(words.select("id", "word"), "id")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), " ").alias("phrase")
    ranked = _first(reached.join(letters.groupBy("ids").agg(phrase), "ids"), [*order, F.asc("phrase")], first)
    totals = chunks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _first(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each language with their rank, in three steps, so that no task ranks a whole language."""
    for parts in (256, 8, 1):
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)))
        rows = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= n)
    return rows.drop("part")
