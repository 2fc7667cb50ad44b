"""License notices in texts: an exact set-similarity join of text blocks with notice templates.

A block is any run of as many consecutive words as the template has (a shorter text is one block); it holds the template
when at least ``threshold`` of the template's distinct words stand in it. How often the templates' words occur in all
documents is counted first; it orders them, rarest first. Then

* prefix: a block that reaches the threshold holds one of the template's first ``d - need + 1`` words in this order;
* length: a block of fewer than ``need`` words, or of fewer places with template words, cannot reach it;
* position: what a block can still share is bounded by the words from its rarest one on;

and what is left is verified on bit sets. Blocks that begin at a template word are enough: any other block shares
nothing more than that which begins at its first template word. The templates are a parameter of bounded size (at most
``MOST_WORDS`` words), so they travel with the tasks; texts are read twice and never shuffled.

Defined results: a null or empty text has no words and no labels; repeated rows and ids give a row each; ties between
blocks go to the first; an empty table gives no rows; texts of any length are scanned whole; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlens.llm.base import map_texts, small_batches
from chatterlens.llm.words import Words, byte_class, lowered

MOST_WORDS = 100_000
INSIDE = byte_class([*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)])

#: Phrases whose places are counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Usual notices of public licenses by label.
TEMPLATES: dict[str, Sequence[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
}
MATCH = "array<struct<label:string,template:int,first_word:long,last_word:long,shared:int,containment:double>>"


def words_of(text: str) -> list[bytes]:
    return Words(lowered(text.encode()), INSIDE).array.to_pylist()


def needed(distinct: int, percent: int) -> int:
    """The least number of shared words."""
    return -(-percent * distinct // 100)


class _Batch:
    """The words of some texts as codes in the vocabulary (-1: none of its words)."""

    def __init__(self, texts: list[bytes], vocabulary: pa.Array):
        self.words = Words(lowered(b"\n".join(texts)), INSIDE)
        self.codes = pc.fill_null(pc.index_in(self.words.array, value_set=vocabulary), -1).to_numpy()
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        #: Per text the place behind its last word.
        self.ends = np.searchsorted(self.words.starts, ends)
        self.begins = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        self.hits = np.flatnonzero(self.codes >= 0)
        self.hit_codes = self.codes[self.hits]

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")

    def phrase(self, codes: Sequence[int]) -> np.ndarray:
        """Places where the codes stand one after the other in one text."""
        starts = self.hits[self.hit_codes == codes[0]]
        starts = starts[starts + len(codes) <= self.ends[self.text_of(starts)]] if len(starts) else starts
        for i, code in enumerate(codes[1:], 1):
            starts = starts[self.codes[starts + i] == code]
        return starts


class Template:
    """One template, its words in the global order."""

    def __init__(self, label: str, number: int, codes: list[int], frequency: np.ndarray, percent: int):
        self.label, self.number, self.length = label, number, len(codes)
        self.order = np.array(sorted(set(codes), key=lambda c: (frequency[c], c)))
        self.size = len(self.order)
        self.need = needed(self.size, percent)
        self.rank = np.full(len(frequency), -1)
        self.rank[self.order] = np.arange(self.size)
        #: A block shares at most ``size - rank`` words if this is its rarest, so only the first ones can start a match.
        self.prefix = self.size - self.need + 1

    def matches(self, batch: _Batch, occurring: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, first place, last place, shared) of the best block of every run of overlapping blocks that reach the threshold."""
        if not occurring[self.order[: self.prefix]].any():
            return []
        ranks = self.rank[batch.hit_codes]
        places, ranks = batch.hits[ranks >= 0], ranks[ranks >= 0]
        text = batch.text_of(places)
        upto = np.searchsorted(places, np.minimum(places + self.length, batch.ends[text]))
        rare = np.concatenate(([0], np.cumsum(ranks < self.prefix)))
        at = np.arange(len(places))
        able = np.flatnonzero((rare[upto] > rare[at]) & (upto - at >= self.need))
        if not len(able):
            return []
        shared = self._shared(ranks, able, upto[able])
        able, shared = able[shared >= self.need], shared[shared >= self.need]
        found: list[tuple[int, int, int, int]] = []
        reach = -1
        for i, n in zip(able.tolist(), shared.tolist()):
            block = (int(text[i]), int(places[i]), int(places[upto[i] - 1]), n)
            if found and places[i] <= reach and found[-1][0] == block[0]:
                if n > found[-1][3]:
                    found[-1] = block
            else:
                found.append(block)
            reach = block[2]
        return found

    def _shared(self, ranks: np.ndarray, first: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Distinct template words from hit ``first`` to ``upto``, by bit sets of 64 words each."""
        total = np.zeros(len(first), np.int64)
        edges = np.stack([first, upto], axis=1).ravel()
        for base in range(0, self.size, 64):
            inside = (ranks >= base) & (ranks < base + 64)
            bits = np.where(inside, np.uint64(1) << np.where(inside, ranks - base, 0).astype(np.uint64), np.uint64(0))
            # One more cell, as the last block may end at the end.
            union = np.bitwise_or.reduceat(np.append(bits, np.uint64(0)), edges)[::2]
            total += np.bitwise_count(union)
        return total


def scan_licenses(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, Sequence[str]] = TEMPLATES, percent: int = 80,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score and ``matches``.

    ``score`` is 1 where a phrase stands, else the greatest containment of a template found, 0 without one.
    """
    if not 0 < percent <= 100:
        raise ValueError("the threshold is a percentage above 0")
    spelled = [(label, i, words_of(t)) for label, texts in templates.items() for i, t in enumerate(texts)]
    spelled = [t for t in spelled if t[2]]
    base = [(words_of(p), label) for p, label in phrases.items()]
    base = [p for p in base if p[0]]
    listed = sorted({w for words in [*[t[2] for t in spelled], *[p[0] for p in base]] for w in words})
    if len(listed) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} distinct words")
    code = {w: i for i, w in enumerate(listed)}
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(listed, pa.large_binary())
        total = np.zeros(len(listed), np.int64)
        for batch in batches:
            total += np.bincount(_Batch(batch.column(0).cast(pa.binary()).to_pylist(), vocabulary).hit_codes, minlength=len(listed))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(listed)), pa.int32()), pa.array(total)], names=["code", "n"])

    texts = docs.select(F.col(text_col).alias("text")).filter("text IS NOT NULL")
    frequency = np.zeros(len(listed), np.int64)
    # At most one row per word of the templates.
    for row in texts.mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        frequency[row["code"]] = row["n"]

    def work() -> Callable[[list], dict]:
        vocabulary = pa.array(listed, pa.large_binary())
        known = [Template(label, i, [code[w] for w in words], frequency, percent) for label, i, words in spelled]

        def run(found: list[str]) -> dict:
            batch = _Batch([t.encode() for t in found], vocabulary)
            occurring = np.bincount(batch.hit_codes, minlength=len(listed)) > 0
            n = len(found)
            n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base_labels: list[set] = [set() for _ in range(n)]
            matches: list[list] = [[] for _ in range(n)]
            for words, label in base:
                places = batch.phrase([code[w] for w in words])
                where = batch.text_of(places)
                inside = places - batch.begins[where] if len(places) else places
                n_base += np.bincount(where, minlength=n)
                np.minimum.at(first, where, inside)
                np.maximum.at(last, where, inside)
                for i in np.unique(where):
                    base_labels[i].add(label)
            for t in known:
                for i, start, end, shared in t.matches(batch, occurring):
                    begin = int(batch.begins[i])
                    matches[i].append({"label": t.label, "template": t.number, "first_word": start - begin, "last_word": end - begin,
                                       "shared": shared, "containment": shared / t.size})
            none = n_base == 0
            labels = [",".join(sorted(b | {m["label"] for m in ms})) for b, ms in zip(base_labels, matches)]
            scores = [1.0 if b else max((m["containment"] for m in ms), default=0.0) for b, ms in zip(base_labels, matches)]
            return {
                "n_words": batch.ends - batch.begins, "n_base": n_base, "first_word": pa.array(first, mask=none), "last_word": pa.array(last, mask=none),
                "base_labels": [",".join(sorted(b)) for b in base_labels], "labels": labels, "score": pa.array(scores, pa.float64()),
                "matches": pa.array(matches, MATCH_TYPE),
            }

        return run

    return map_texts(docs, id_col, text_col, work,
                     f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches {MATCH}")


MATCH_TYPE = pa.list_(pa.struct([
    ("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("shared", pa.int32()), ("containment", pa.float64()),
]))
