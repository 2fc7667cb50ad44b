"""Packing of token sequences into fixed windows by minimum bin slack.

A document of T tokens (its ids and an end id) fills T // window windows by itself; the remaining T % window tokens are
its rest. There are fewer rest lengths than window positions, so the whole corpus is planned from one bounded histogram:
subset-sum dynamic programming on bit sets finds the multiset of rests that fills a window closest to its capacity,
always with the longest rest left in it, and the backtracked counts are applied as often as the histogram allows.
Where no multiset fills a window exactly, its slack is closed by cutting: rests without an exact fill are laid end to
end and cut at window ends, so only the very last window can be padded.

The plan is a table of rank intervals per rest length, a few thousand rows at most for any number of documents. Ranks
come from salted groups (length, salt) with running totals, so a length that a third of all documents share is spread
over all tasks; sequence numbers and offsets follow from the rank in closed form.

Defined results: a null text counts as empty and still has its end id; equal rows get places of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterlens.llm.base import Memory, map_texts, written
from chatterlens.llm.words import byte_class

KEPT_WORDS = 300_000  # words per generation whose ids a worker remembers
#: White space that isn't a single space or line end.
UNUSUAL = ["  ", "\n\n", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
LETTER = byte_class(string.ascii_letters.encode())
BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")
PLAIN = re.compile(r" ?\S+")
LEAST_SALTS = 256
ROWS_PER_SALT = 20_000


class ByteEncoder:
    """Ids of whole texts by the library, which sees each distinct word once per generation of the memory.

    Texts are cut where the byte-level pre-tokenizer always cuts: before a single space between two other characters
    and around a single line end between two other characters.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives each task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = end[0] if len(end) == 1 else None
        self.words = Memory(KEPT_WORDS)

    @staticmethod
    def cut(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts as one array of bytes, and after how many of them each text ends."""
        coded = [t.encode() for t in texts]
        usual = [not t or not (t[0].isspace() or t[-1].isspace() or any(u in t for u in UNUSUAL)) for t in texts]
        raw = np.frombuffer(b"".join(coded), np.uint8)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ends = np.cumsum(sizes)
        edge = np.zeros(len(raw) + 1, bool)
        edge[ends] = True
        edge[0] = True
        line = raw == 10
        space = (raw == 32) | line
        # A full stop or comma behind a letter is a pre-token of its own where the word ends with it.
        stop = np.flatnonzero((raw == ord(".")) | (raw == ord(",")))
        stop = stop[(np.append(space, True)[stop + 1] | edge[stop + 1]) & LETTER[raw[stop - 1]] & ~edge[stop]]
        inside = np.repeat(usual, sizes)
        mark = space.copy()
        mark[1:] |= line[:-1]
        mark[stop] = True
        edge[:-1] |= mark & inside
        for i in np.flatnonzero(~np.array(usual, bool)):
            pieces = [len(w.encode()) for w in BEFORE_SPACE.split(texts[i])]
            edge[ends[i] - sizes[i] + np.cumsum(pieces[:-1], dtype=np.int64)] = True
        places = np.flatnonzero(edge)
        words = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(raw)])
        return words, np.searchsorted(places, ends)

    def learn(self, words: list[bytes]) -> None:
        """Remembers the ids of new words. Those without white space, but for one space in front, go to the library many
        at a time with line ends between, which it always makes tokens of their own."""
        size = self.kind.itemsize
        parts = [w.decode() for w in words]
        plain = [self.line_end is not None and PLAIN.fullmatch(p) is not None for p in parts]
        joined, alone = list(compress(zip(words, parts), plain)), [x for x, ok in zip(zip(words, parts), plain) if not ok]
        for i in range(0, len(joined), 4096):
            groups = [joined[j : j + 64] for j in range(i, min(i + 4096, len(joined)), 64)]
            lines = ["\n".join([p for _, p in g]) for g in groups]
            for group, made in zip(groups, self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
                ids = np.array(made.ids, self.kind)
                ends = np.flatnonzero(ids == self.line_end)
                if len(ends) != len(group) - 1:  # an added token of the vocabulary took a line end
                    alone += group
                    continue
                raw, bounds = ids.tobytes(), [-1, *ends.tolist(), len(ids)]
                self.words.now.update((w, raw[(x + 1) * size : y * size]) for (w, _), (x, y) in zip(group, pairwise(bounds)))
        for i in range(0, len(alone), 4096):
            some = alone[i : i + 4096]
            for (word, _), made in zip(some, self.tokenizer.encode_batch_fast([p for _, p in some], add_special_tokens=False)):
                self.words.now[word] = np.array(made.ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut, last = self.cut(texts)
        coded = cut.dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        new = self.words.missing(words)
        self.learn(new)
        raw = list(map(self.words.now.__getitem__, words))
        self.words.settle(new)
        # The ids of the distinct words, end to end, and for every id of the texts its place there.
        flat, lengths = np.frombuffer(b"".join(raw), self.kind), np.fromiter(map(len, raw), np.int64, len(raw)) // self.kind.itemsize
        number = lengths[codes]
        ends = np.cumsum(number)
        places = np.repeat((np.cumsum(lengths) - lengths)[codes] - (ends - number), number) + np.arange(number.sum())
        bounds = np.append(0, ends)[np.append(0, last)]
        ids = flat[places]
        return [ids[a:b] for a, b in pairwise(bounds.tolist())]


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    """One per Python worker, which serves many tasks."""
    return ByteEncoder(path)


def best_fill(room: int, counts: dict[int, int]) -> tuple[int, dict[int, int]]:
    """The multiset of lengths (at most ``counts`` of each) with the largest sum up to ``room``, by subset sums on bit sets."""
    mask = (1 << (room + 1)) - 1
    reach, states = 1, []
    for length in sorted(counts, reverse=True):
        left, lot = min(counts[length], room // length), 1
        while left > 0:  # lots of 1, 2, 4, ... and the rest stand for any number
            lot = min(lot, left)
            states.append((length, lot, reach))
            reach |= (reach << (length * lot)) & mask
            left, lot = left - lot, lot * 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    at = total
    for length, lot, before in reversed(states):
        if not before >> at & 1:
            at -= length * lot
            used[length] = used.get(length, 0) + lot
    return total, used


def slack_plan(histogram: dict[int, int], window: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Patterns (multiset of lengths, how often) that fill windows exactly, and the rests that no multiset completes."""
    left = {length: n for length, n in histogram.items() if n > 0}
    patterns, over = [], {}
    while left:
        longest = max(left)
        others = dict(left)
        others[longest] -= 1
        total, used = best_fill(window - longest, {k: n for k, n in others.items() if n})
        if longest + total < window:  # the others only get fewer, so no later window is exact either
            over[longest] = left.pop(longest)
            continue
        used[longest] = used.get(longest, 0) + 1
        times = min(left[length] // n for length, n in used.items())
        patterns.append((used, times))
        for length, n in used.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return patterns, over


class Places:
    """The plan as rank intervals per rest length, for lookups with arrays."""

    def __init__(self, histogram: dict[int, int], window: int):
        patterns, over = slack_plan(histogram, window)
        rows, rank, sequence = [], dict.fromkeys(histogram, 0), 0
        for used, times in patterns:
            offset = 0
            for length, n in used.items():
                rows.append((length, rank[length], sequence, n, offset, -1))
                rank[length] += n * times
                offset += n * length
            sequence += times
        position = 0
        for length, n in over.items():
            rows.append((length, rank[length], sequence, 1, 0, position))
            position += n * length
        self.next_sequence = sequence + -(-position // window)
        table = np.array(sorted(rows), np.int64).reshape(-1, 6)
        self.window = window
        self.key = table[:, 0] << 44 | table[:, 1]
        self.start, self.sequence, self.times, self.offset, self.position = table[:, 1:].T

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence and offset of each rest, and how much of it still fits there."""
        at = np.searchsorted(self.key, length << 44 | rank, side="right") - 1
        step = rank - self.start[at]
        position = self.position[at] + step * length
        cut = self.position[at] >= 0
        sequence = self.sequence[at] + np.where(cut, position // self.window, step // self.times[at])
        offset = np.where(cut, position % self.window, self.offset[at] + step % self.times[at] * length)
        return sequence, offset, np.minimum(length, self.window - offset)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: its tokens, the checksums of its full windows, the length and the ids of its rest."""

    def work():
        coder = byte_encoder(tokenizer_path)

        def function(texts: list[str]) -> dict:
            tokens, full, rest = [], [], []
            for ids in coder.encode(texts):
                ids = np.append(ids, np.array([end_id], coder.kind))
                whole = len(ids) // window
                tokens.append(len(ids))
                full.append([crc(ids[k * window : (k + 1) * window]) for k in range(whole)])
                rest.append(ids[whole * window :].tobytes())
            tokens = np.array(tokens, np.int64)
            return {"doc_tokens": tokens, "full": pa.array(full, pa.list_(pa.int64())), "rest_len": tokens % window, "rest": pa.array(rest, pa.binary())}

        return function

    return map_texts(docs, id_col, text_col, work, "doc_tokens long, full array<long>, rest_len long, rest binary")


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: document, start in it, length, checksum of the ids, sequence and offset in it."""
    rows = written(tokenized(docs, tokenizer_path, window, end_id, id_col, text_col), "tokens")
    # At most ``window`` rows, whatever the number of documents.
    totals = rows.groupBy("rest_len").agg(F.count("*").alias("n"), F.sum(F.size("full")).alias("f")).collect()
    places = Places({r["rest_len"]: r["n"] for r in totals if r["rest_len"]}, window)
    first_full, running = {}, places.next_sequence
    for r in sorted(totals):
        first_full[r["rest_len"]] = running
        running += r["f"]
    salts = max(LEAST_SALTS, -(-sum(r["n"] for r in totals) // ROWS_PER_SALT))

    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.col(id_col), "doc_tokens", "rest"), F.lit(salts)))
    group = ("rest_len", "salt")
    sizes = salted.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.size("full")).alias("f"))
    ahead = Window.partitionBy("rest_len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n_ahead"), F.coalesce(F.sum("f").over(ahead), F.lit(0)).alias("f_ahead"))
    inside = Window.partitionBy(*group).orderBy(id_col, "doc_tokens", "rest")
    ranked = salted.withColumn("r", F.row_number().over(inside).cast("long") - 1).withColumn(
        "f", F.coalesce(F.sum(F.size("full")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.join(offsets, list(group)).select(
        F.col(id_col).alias("id"), "doc_tokens", "full", "rest_len", "rest", (F.col("r") + F.col("n_ahead")).alias("rank"), (F.col("f") + F.col("f_ahead")).alias("full_rank"))

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, lengths, ranks, full_ranks = (batch.column(n).to_numpy() for n in ("doc_tokens", "rest_len", "rank", "full_rank"))
            full, rests = batch.column("full").to_pylist(), batch.column("rest").to_pylist()
            out = []  # row in the batch, start, length, checksum, sequence, offset
            for i, sums in enumerate(full):
                base = first_full[int(lengths[i])] + int(full_ranks[i])
                out += [(i, k * window, window, c, base + k, 0) for k, c in enumerate(sums)]
            some = np.flatnonzero(lengths)
            if len(some):
                sequence, offset, fits = places.find(lengths[some], ranks[some])
                for i, s, o, n in zip(some.tolist(), sequence.tolist(), offset.tolist(), fits.tolist()):
                    raw, length = rests[i], int(lengths[i])
                    ids = np.frombuffer(raw, f"<u{len(raw) // length}")
                    begin = len(full[i]) * window
                    out.append((i, begin, n, crc(ids[:n]), s, o))
                    if n < length:
                        out.append((i, begin + n, length - n, crc(ids[n:]), s + 1, 0))
            at, *columns = (np.array(c, np.int64) for c in zip(*out))
            columns.insert(3, tokens[at])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), *map(pa.array, columns)], names=names)

    kind = ranked.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names[1:])).withColumnRenamed("id", id_col)
