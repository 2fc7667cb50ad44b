"""Counting quotient filters of packed word-id n-grams, without loss.

The ids of an n-gram are packed into one integer of twice ``half`` bits. A Feistel network over the two halves permutes
these integers invertibly and evenly. The top bits of the permuted value name the shard, the next ones are the quotient,
all the others the remainder. A filter holds, for the sorted entries of one shard: one bit per quotient that occurs, one
bit per entry that ends its quotient's run, the full remainders, and the counters (a bit for "more than one", then the
counts themselves). As nothing of the value is dropped, two n-grams never share an entry, and the n-grams come back by
the inverse. Sorted filters merge by adding the counters of equal values.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

ROUNDS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
WIDEST_HALF = 63


@dataclass(frozen=True)
class Layout:
    """How n-grams of ``words`` ids with ``bits`` bits each are packed and dealt into ``2 ** shard_bits`` shards."""

    words: int
    bits: int
    wanted_shard_bits: int = 0

    def __post_init__(self):
        if self.half > WIDEST_HALF:
            raise ValueError(f"{self.words} ids of {self.bits} bits do not fit into {2 * WIDEST_HALF} bits")

    @property
    def half(self) -> int:
        return -(-self.words * self.bits // 2)

    @property
    def shard_bits(self) -> int:
        return min(self.wanted_shard_bits, self.half)

    def pack(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        high, low = np.zeros(len(ids[0]), np.uint64), np.zeros(len(ids[0]), np.uint64)
        for place, word in enumerate(reversed(ids)):
            word, at = word.astype(np.uint64), place * self.bits
            if at < self.half:
                low |= word << np.uint64(at)
                if at + self.bits > self.half:
                    high |= word >> np.uint64(self.half - at)
            else:
                high |= word << np.uint64(at - self.half)
        return high, low & _mask(self.half)

    def unpack(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        ids = []
        for place in reversed(range(self.words)):
            at = place * self.bits
            if at < self.half:
                word = low >> np.uint64(at)
                if at + self.bits > self.half:
                    word = word | (high << np.uint64(self.half - at))
            else:
                word = high >> np.uint64(at - self.half)
            ids.append((word & _mask(self.bits)).astype(np.int64))
        return ids

    def _mixed(self, values: np.ndarray, key: int) -> np.ndarray:
        mixed = (values + np.uint64(key)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(33)
        mixed *= np.uint64(0xC4CEB9FE1A85EC53)
        return (mixed >> np.uint64(64 - self.half)) if self.half else np.zeros_like(values)

    def permuted(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for key in ROUNDS:
            high, low = low, high ^ self._mixed(low, key)
        return high, low

    def restored(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for key in reversed(ROUNDS):
            high, low = low ^ self._mixed(high, key), high
        return high, low

    def counted(self, ids: list[np.ndarray]) -> Entries:
        """The distinct n-grams with their counts, sorted by their permuted values."""
        high, low = self.permuted(*self.pack(ids))
        if 2 * self.half <= 64:
            keys = np.sort((high << np.uint64(self.half)) | low)
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
            counts = np.diff(np.append(first, len(keys)))
            keys = keys[first]
            return Entries(self, keys >> np.uint64(self.half), keys & _mask(self.half), counts)
        return Entries(self, high, low, np.ones(len(high), np.int64)).merged()


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _planes(values: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` bits of every value in as many whole bytes as they need."""
    width = -(-bits // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _from_planes(raw: memoryview, bits: int, n: int) -> np.ndarray:
    width = -(-bits // 8)
    whole = np.zeros((n, 8), np.uint8)
    whole[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(n, width)
    return whole.view("<u8").ravel()


@dataclass
class Entries:
    """Permuted values in two halves with their counts; sorted unless said otherwise."""

    layout: Layout
    high: np.ndarray
    low: np.ndarray
    counts: np.ndarray

    def __len__(self) -> int:
        return len(self.counts)

    @staticmethod
    def joined(parts: list[Entries]) -> Entries:
        """Several sorted filters' entries merged into one."""
        if len(parts) == 1:
            return parts[0]
        return Entries(parts[0].layout, *(np.concatenate([getattr(p, c) for p in parts]) for c in ("high", "low", "counts"))).merged()

    def merged(self) -> Entries:
        """Sorted, with the counts of equal values added up. The stable sort profits from runs that are sorted already."""
        if not len(self):
            return self
        half = self.layout.half
        order = (
            np.argsort((self.high << np.uint64(half)) | self.low, kind="stable") if 2 * half <= 64 else np.lexsort((self.low, self.high))
        )
        high, low, counts = self.high[order], self.low[order], self.counts[order]
        first = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))
        return Entries(self.layout, high[first], low[first], np.add.reduceat(counts, first))

    def at_least(self, least: int) -> Entries:
        keep = self.counts >= least
        return Entries(self.layout, self.high[keep], self.low[keep], self.counts[keep])

    def ids(self) -> list[np.ndarray]:
        return self.layout.unpack(*self.layout.restored(self.high, self.low))

    def filters(self) -> list[tuple[int, bytes]]:
        """(shard, filter) of the sorted entries."""
        shift = np.uint64(self.layout.half - self.layout.shard_bits)
        shards = (self.high >> shift).astype(np.int64)
        starts = np.flatnonzero(np.diff(shards, prepend=-1)) if len(shards) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(shards))
        return [(int(shards[a]), self._filter(slice(a, b))) for a, b in zip(starts, ends)]

    def _filter(self, part: slice) -> bytes:
        below = self.layout.half - self.layout.shard_bits
        high, low, counts = self.high[part] & _mask(below), self.low[part], self.counts[part]
        n = len(counts)
        quotient_bits = min(below, max(0, n.bit_length() - 1))
        left = below - quotient_bits
        quotients = (high >> np.uint64(left)).astype(np.int64)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotients] = True
        run_ends = np.append(quotients[1:] != quotients[:-1], True)
        many = counts > 1
        return b"".join((
            struct.pack("<qb", n, quotient_bits), np.packbits(occupied).tobytes(), np.packbits(run_ends).tobytes(), np.packbits(many).tobytes(),
            _planes(high & _mask(left), left), _planes(low, self.layout.half), _counters(counts[many]),
        ))


def _counters(counts: np.ndarray) -> bytes:
    """Counts above one: a byte each, and eight more for those that do not fit."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def entries(layout: Layout, shard: int, raw: bytes) -> Entries:
    """The sorted entries of one filter."""
    view = memoryview(raw)
    n, quotient_bits = struct.unpack_from("<qb", view)
    at = 9

    def take(size: int) -> memoryview:
        nonlocal at
        at += size
        return view[at - size : at]

    def flags(size: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(take(-(-size // 8)), np.uint8), count=size).astype(bool)

    below = layout.half - layout.shard_bits
    left = below - quotient_bits
    occupied, run_ends, many = flags(1 << quotient_bits), flags(n), flags(n)
    runs = np.cumsum(run_ends) - run_ends
    high = np.flatnonzero(occupied).astype(np.uint64)[runs] << np.uint64(left)
    high |= _from_planes(take(n * -(-left // 8)), left, n)
    high |= np.uint64(shard) << np.uint64(below) if layout.shard_bits else np.uint64(0)
    low = _from_planes(take(n * -(-layout.half // 8)), layout.half, n)
    counts = np.ones(n, np.int64)
    some = np.frombuffer(take(int(many.sum())), np.uint8).astype(np.int64)
    large = some == 255
    some[large] = np.frombuffer(view[at:], "<i8", int(large.sum()))
    counts[many] = some
    return Entries(layout, high, low, counts)
