"""Toxicity by class-conditional Kneser-Ney models, one of toxic and one of ordinary labelled documents.

Each class has an interpolated pair model. The chance of word w behind v is

    max(c(v, w) - D, 0) / c(v)  +  back(v) * [ max(n(w) - D, 0) / N  +  free * shared(w) ]

with c(v, w) the labelled documents of the class that hold the pair, n(w) the class's continuation count (different words
seen before w), and ``shared(w)`` the continuation count over all documents; absolute discounts free the mass that backs
off. A pair or word that no class has more than D times has nothing left after the discount: both models back off to the
same shared chance, so it tells nothing and needs no entry. What is left out of the tables is exactly that, no cap.

A document's inputs are the difference of the two log-likelihoods divided by its length, the greatest differences at
the continuation level (at most four different words), and its length; a logistic curve on labelled documents that the
counts have not seen turns them into a score.

Scale: class counts come from the labelled sample, aggregated as pairs in Spark. The shared counts come from all
documents: per word of the models eight 64-bit maps of the words before it, at sampling rates 1, 1/4, 1/16, ..., which
Spark merges by ``bit_or`` (a distinct count to about a tenth, nearly exact for rare words). The models travel with the
tasks. Their size is bounded by the sample: every entry stands for at least three of its pairs. Words are 64-bit hashes.

Bounds (parameters): the classifier learns from at most ``sample_rows`` labelled rows, those with the smallest hash of
their id, as long as their texts stay within ``sample_chars`` in all; a quarter of them calibrates, the others are
counted. With fewer than ``LEAST_ROWS`` rows of a class in one of these parts, all rows do both.

Defined results: a null text counts as empty and is scored like an empty one; labels that are null or not 0 or 1 are left
out; of several labels of one id the largest counts; without labelled documents of both classes every score is the share
of toxic ones (0 without any); rows with equal ids are scored each by their text; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlens.llm.base import row_key, small_batches, written
from chatterlens.llm.words import byte_class

DISCOUNT = 2
LEAST_ROWS = 8
HELD_PAIRS = 2_000_000  # pairs that a task gathers before it hands on their counts
INSIDE = ~byte_class(b" \t\n\r\x0b\x0c" + string.punctuation.encode())
POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64))
PAIR = np.uint64(0xD6E8FEB86659FD93)
LEVELS = 8  # maps per word, each of 64 bits
TOP = 4
FEATURES = TOP + 2


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word of the lower-cased texts: its text's number, the hash of the word before it (0 at a start), its own."""
    lowered = [t.lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\n".join(lowered) + b"\n", np.uint8)
    marks = INSIDE[raw]
    edges = np.flatnonzero(np.diff(marks, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    letters = raw[marks]
    first = np.cumsum(lengths) - lengths
    places = (np.arange(len(letters)) - np.repeat(first, lengths)) & (len(POWERS) - 1)
    words = mixed(np.add.reduceat((letters + np.uint64(1)) * POWERS[places], first) + lengths.astype(np.uint64))
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), starts, side="right")
    before = np.append(np.uint64(0), words[:-1])
    before[np.append(True, doc[1:] != doc[:-1])] = 0
    return doc, before, words


def pair_hash(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(before * PAIR + words)


class Lookup:
    """Places of 64-bit hashes in a table: keys in order, and where those with the same first bits begin."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys  # in ascending order
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.begin).max())

    def find(self, some: np.ndarray) -> np.ndarray:
        """The place of each hash, or the number of keys."""
        out = np.full(len(some), len(self.keys), np.int64)
        if not len(self.keys):
            return out
        at = self.begin[(some >> self.shift).astype(np.int64)].astype(np.int64)
        for _ in range(self.longest):
            near = np.minimum(at, len(self.keys) - 1)
            hit = self.keys[near] == some
            out[hit] = near[hit]
            at += 1
        return out


@dataclass
class Model:
    """Log ratios toxic to ordinary, less that of a word in neither model: per word as the one before and as the one
    itself, per pair for both together; the last entry of each is that of what the tables don't hold."""

    words: Lookup
    context: np.ndarray
    word: np.ndarray
    pairs: Lookup
    pair: np.ndarray

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: the greatest word ratios, the mean ratio of its pairs, the logarithm of its length."""
        doc, before, words = word_hashes(texts)
        out = np.zeros((len(texts), FEATURES))
        at = self.words.find(words)
        single = self.word[at]
        whole = self.pair[self.pairs.find(pair_hash(before, words))]
        whole = np.where(np.isnan(whole), self.context[self.words.find(before)] + single, whole)
        n = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
        out[:, TOP] = np.bincount(doc, whole, minlength=len(texts)) / n
        out[:, TOP + 1] = np.log(n)
        some = np.flatnonzero(single > 0)
        if len(some):
            size = len(self.word)
            found = np.unique(doc[some] * size + at[some])  # every word of a text once
            d, value = found // size, self.word[found % size]
            order = np.lexsort((-value, d))
            d, value = d[order], value[order]
            rank = np.arange(len(d)) - np.searchsorted(d, d)
            best = rank < TOP
            out[d[best], rank[best]] = value[best]
        return out


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int, sample_chars: int, id_col: str, label_col: str) -> DataFrame:
    """``id``, ``label`` and ``part`` (0 calibrates, 1 to 3 are counted) of the labelled rows to learn from."""
    rows = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    rows = rows.withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(sample_rows)
    sizes = docs.select("id", F.length("text").alias("n")).join(F.broadcast(rows), "id").groupBy("id", "label", "place").agg(F.sum("n").alias("n"))
    ahead = F.sum("n").over(Window.orderBy("place", "id"))  # at most ``sample_rows`` rows
    return sizes.withColumn("ahead", ahead).filter(F.col("ahead") <= sample_chars).select("id", "label", F.pmod("place", F.lit(4)).cast("int").alias("part"))


def class_pairs(docs: DataFrame) -> DataFrame:
    """Documents of each class (``c0``, ``c1``) per pair of neighbouring words (``v``, ``w``) of (text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            before, words, label = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((words, before))
            before, words, label = before[order], words[order], label[order]
            first = np.flatnonzero(np.append(True, (before[1:] != before[:-1]) | (words[1:] != words[:-1])))
            toxic = np.add.reduceat(label, first)
            number = np.diff(np.append(first, len(words)))
            return pa.RecordBatch.from_arrays(
                [pa.array(before[first].view(np.int64)), pa.array(words[first].view(np.int64)), pa.array(number - toxic), pa.array(toxic)], names=["v", "w", "c0", "c1"])

        for batch in batches:
            doc, before, words = word_hashes(batch.column(0).to_pylist())
            if not len(doc):
                continue
            order = np.lexsort((pair_hash(before, words), doc))
            doc, before, words = doc[order], before[order], words[order]
            once = np.append(True, (doc[1:] != doc[:-1]) | (before[1:] != before[:-1]) | (words[1:] != words[:-1]))
            label = batch.column(1).to_numpy().astype(np.int64)[doc[once]]
            held.append((before[once], words[once], label))
            size += len(label)
            if size > HELD_PAIRS:
                yield summed()
                held, size = [], 0
        if held:
            yield summed()

    made = docs.select("text", "label").mapInArrow(run, "v long, w long, c0 long, c1 long")
    # Dealt by the first word alone, so that equal numbers stay together and compress; the sample bounds its pairs.
    return made.repartition("v").groupBy("v", "w").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def unsigned(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy().astype(np.int64).view(np.uint64)


def both(table: pa.Table, first: str, second: str) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().astype(np.float64) for c in (first, second)])


def shared_counts(docs: DataFrame, words: Lookup) -> np.ndarray:
    """Different words before each word of the table in all documents; last the occurrences of all other words."""
    size = len(words.keys)
    given = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, others = np.zeros(size * LEVELS, np.uint64), 0
        for batch in batches:
            _, before, found = word_hashes(batch.column(0).to_pylist())
            at = given.value.find(found)
            known = at < size
            others += int(len(at) - known.sum())
            hashed = mixed(before[known] ^ PAIR)
            # A share of 3/4 goes to the first map, 3/16 to the second, ... and the rest to the last one.
            level = np.minimum((64 - np.frexp((hashed >> np.uint64(6)).astype(np.float64))[1] - 6) // 2, LEVELS - 1)
            np.bitwise_or.at(maps, at[known] * LEVELS + level, np.uint64(1) << (hashed & np.uint64(63)))
        table = maps.view(np.int64).reshape(size, LEVELS)
        some = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, size)), *(pa.array(np.append(table[some, i], 0)) for i in range(LEVELS)), pa.array(np.append(np.zeros(len(some), np.int64), others))],
            names=["at", *(f"b{i}" for i in range(LEVELS)), "others"])

    made = docs.select("text").mapInArrow(run, "at long, " + ", ".join(f"b{i} long" for i in range(LEVELS)) + ", others long")
    bits = [F.bit_count(F.bit_or(f"b{i}")).alias(f"b{i}") for i in range(LEVELS)]
    got = made.groupBy("at").agg(*bits, F.sum("others").alias("others")).toArrow()
    at = got.column("at").to_numpy()
    out = np.zeros(size + 1)
    out[at] = distinct(np.stack([got.column(f"b{i}").to_numpy() for i in range(LEVELS)], axis=1))
    out[size] = got.column("others").to_numpy().sum()
    return out


def distinct(bits: np.ndarray) -> np.ndarray:
    """Estimates from the set bits per level: linear counts of the levels from the first that is at most 3/4 full on."""
    counts = -64 * np.log(1 - np.minimum(bits, 63) / 64)
    after = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
    fit = bits <= 48
    fit[:, -1] = True
    first = np.argmax(fit, axis=1)
    return after[np.arange(len(bits)), first] * 4.0**first


def trained(docs: DataFrame, learnt: DataFrame) -> Model:
    """The models, from the labelled documents (text, label) and the texts of all."""
    pairs = written(class_pairs(learnt), "toxicity-pairs")
    seen = [F.sum((F.col(f"c{k}") > 0).cast("long")).alias(f"n{k}") for k in (0, 1)]
    words = written(pairs.groupBy("w").agg(*seen), "toxicity-words")
    more = lambda name: (F.col(f"{name}0") > DISCOUNT) | (F.col(f"{name}1") > DISCOUNT)
    sums = [F.sum(f"n{k}").alias(f"all{k}") for k in (0, 1)] + [F.sum(F.least(f"n{k}", F.lit(DISCOUNT))).alias(f"free{k}") for k in (0, 1)]
    total = words.agg(*[F.coalesce(s, F.lit(0)).alias(n) for s, n in zip(sums, ("all0", "all1", "free0", "free1"))]).first()
    size = [max(total["all0"], 1), max(total["all1"], 1)]
    free = [max(total[f"free{k}"], 1) / size[k] for k in (0, 1)]

    heavy = pairs.filter(more("c")).toArrow()
    kept_words = words.filter(more("n")).toArrow()
    sums = [F.sum(f"c{k}").alias(f"c{k}") for k in (0, 1)] + [F.sum(F.least(f"c{k}", F.lit(DISCOUNT))).alias(f"d{k}") for k in (0, 1)]
    contexts = pairs.groupBy("v").agg(*sums, F.max(more("c")).alias("more")).filter("more").toArrow()

    def spread(keys: np.ndarray, own: np.ndarray, values: np.ndarray, default: float) -> np.ndarray:
        """Values of ``own`` keys as one array over all keys."""
        out = np.full((2, len(keys)), default)
        out[:, np.searchsorted(keys, own)] = values
        return out

    heavy_v, heavy_w = unsigned(heavy, "v"), unsigned(heavy, "w")
    keys = np.unique(np.concatenate([unsigned(kept_words, "w"), unsigned(contexts, "v"), heavy_w]))
    table = Lookup(keys)
    shared = shared_counts(docs, table)
    base = (shared + 0.5) / (shared.sum() + 0.5 * len(shared))
    continued = spread(keys, unsigned(kept_words, "w"), both(kept_words, "n0", "n1"), 0.0)
    room = both(contexts, "c0", "c1")
    back = spread(keys, unsigned(contexts, "v"), np.where(room > 0, both(contexts, "d0", "d1") / np.maximum(room, 1), 1.0), 1.0)
    context = spread(keys, unsigned(contexts, "v"), room, 0.0)
    chance = np.stack([np.maximum(continued[k] - DISCOUNT, 0) / size[k] + free[k] * base[:-1] for k in (0, 1)])
    offset = np.log(free[1] / free[0])
    v, w = np.searchsorted(keys, heavy_v), np.searchsorted(keys, heavy_w)
    counts = both(heavy, "c0", "c1")
    joint = np.stack([np.maximum(counts[k] - DISCOUNT, 0) / np.maximum(context[k][v], 1) + back[k][v] * chance[k][w] for k in (0, 1)])
    hashes = pair_hash(heavy_v, heavy_w)
    order = np.argsort(hashes)
    return Model(
        table, np.append(np.log(back[1] / back[0]), 0.0), np.append(np.log(chance[1] / chance[0]) - offset, 0.0),
        Lookup(hashes[order]), np.append((np.log(joint[1] / joint[0]) - offset)[order], np.nan))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Coefficients and intercept by Newton steps, for the features as they are."""
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - middle) / scale, np.ones(len(x))]
    b = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(b)), z.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b[:-1] / scale, float(b[-1] - (b[:-1] * middle / scale).sum())


def score_toxicity(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 100_000, sample_chars: int = 1 << 28,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> DataFrame:
    """``held_out``, ``score`` and ``predicted`` of every document, and ``row_key``, the hash of its text."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row_key(text_col).alias("row_key"))
    sample = written(labelled(texts, labels, sample_rows, sample_chars, id_col, label_col), "toxicity-sample")
    out = [F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out")]
    number = {(r["counted"], r["label"]): r["n"] for r in sample.groupBy((F.col("part") > 0).alias("counted"), "label").agg(F.count("*").alias("n")).collect()}
    toxic, rows = (sum(n for (_, k), n in number.items() if k in some) for some in ((1,), (0, 1)))
    if not 0 < toxic < rows:
        share = toxic / rows if rows else 0.0
        return texts.select(*out, F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"), "row_key")
    apart = all(number.get((counted, k), 0) >= LEAST_ROWS for counted in (False, True) for k in (0, 1))
    marked = texts.join(F.broadcast(sample), "id", "left")
    counted = F.col("label").isNotNull() & ((F.col("part") > 0) if apart else F.lit(True))
    calibrates = F.col("label").isNotNull() & ((F.col("part") == 0) if apart else F.lit(True))
    model = spark.sparkContext.broadcast(trained(texts, marked.filter(counted)))
    names = [f"f{i}" for i in range(FEATURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = model.value.features(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, made.T.copy()), *batch.columns[2:]], names=["id", *names, "label", "row_key"])

    kind = texts.schema["id"].dataType.simpleString()
    inputs = marked.select("id", "text", F.when(calibrates, F.col("label")).alias("label"), "row_key")
    scored = written(inputs.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} double" for n in names) + ", label int, row_key long"), "toxicity")
    # At most ``sample_rows`` ids; rows that share an id count as one.
    learnt = scored.filter("label IS NOT NULL").groupBy("id", "label").agg(*[F.max(n).alias(n) for n in names]).orderBy("id").toArrow()
    weights, intercept = logistic(np.stack([learnt.column(n).to_numpy() for n in names], axis=1), learnt.column("label").to_numpy().astype(np.float64))
    logit = F.lit(intercept)
    for n, w in zip(names, weights.tolist()):
        logit = logit + F.col(n) * w
    score = 1 / (1 + F.exp(-logit))
    return scored.select(*out, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "row_key")
