"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text of more than ``chunk_chars`` characters is encoded in overlapping chunks with offsets. Two neighbouring chunks
are spliced at a common boundary: a character that begins a token in both encodings and follows ASCII white space.
Such a boundary is proven stable: white space is dropped by the tokenizer before any merge, no composition of characters
and no special string spans it, so what follows is encoded alike whatever stood before. If the overlap holds no such
boundary, it is doubled to the left, and beyond the last splice the left chunk itself is doubled to the right, so a text
without white space ends up in one chunk and its count is still exact.

Shorter texts are a single chunk. It falls apart at the same white space, and the library encodes each distinct word
once per task; the counts add up by the same proof.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows and ids are counted each; strings of
special tokens inside a text count as the library treats them by default.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from chatterlens.llm.base import Memory, map_texts

SPACE = frozenset(" \t\n\v\f\r")
KEPT_WORDS = 300_000  # words per generation whose counts a worker remembers
ENDINGS = frozenset(b".,")
PROBE = "Hello  world\n\nfoo, bar.\tbaz 12 x.y ,z"  # shows whether white space makes tokens
LETTERS = frozenset(range(ord("a"), ord("z") + 1))


class ResyncCounter:
    def __init__(self, tokenizer, chunk_chars: int, overlap_chars: int):
        self.tokenizer, self.chunk, self.overlap = tokenizer, chunk_chars, overlap_chars
        self.words = Memory(KEPT_WORDS)
        if self.counts([PROBE])[0] != len(tokenizer.encode(PROBE, add_special_tokens=False).ids):
            raise ValueError("the tokenizer keeps white space; texts cannot be counted word by word")

    def counts(self, texts: list[str]) -> list[int]:
        words = [t.encode().split() if len(t) <= self.chunk else None for t in texts]
        new = self._learn(self.words.missing(chain.from_iterable(filter(None, words))))
        known = self.words.now
        made = [self.spliced(t) if ws is None else sum(map(known.__getitem__, ws)) for t, ws in zip(texts, words)]
        self.words.settle(new)
        return made

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Counts of new words; a letter and a full stop or comma behind it never share a token."""
        whole, known = {}, self.words.now
        for w in new:
            end = len(w) - 1 if len(w) > 1 and w[-1] in ENDINGS and w[-2] in LETTERS else len(w)
            whole[w] = (w[:end], w[end:])
        parts = self.words.missing({p for pair in whole.values() for p in pair if p})
        for i in range(0, len(parts), 4096):
            some = parts[i : i + 4096]
            made = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            known.update(zip(some, map(len, made)))
        for w, (stem, ending) in whole.items():
            if ending:
                known[w] = known[stem] + known[ending]
        return list({*parts, *whole})

    def starts(self, text: str, begin: int, end: int) -> np.ndarray:
        """Where the tokens of text[begin:end] begin, as positions in the text."""
        made = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        return np.array(made.offsets, np.int64).reshape(-1, 2)[:, 0] + begin

    def spliced(self, text: str) -> int:
        n, total, kept = len(text), 0, 0
        begin, end = 0, min(self.chunk, len(text))
        left = self.starts(text, begin, end)
        while end < n:
            overlap, splice = self.overlap, None
            while splice is None:
                start = max(kept, end - overlap)
                stop = min(n, start + max(self.chunk, 2 * (end - start)))
                right = self.starts(text, start, stop)
                common = np.intersect1d(left[(left > start) & (left < end)], right)
                splice = next((int(p) for p in common if p > kept and text[p - 1] in SPACE), None)
                if splice is None and start == kept:
                    break
                overlap *= 2
            if splice is None:  # no boundary in the whole chunk: a longer one
                end = min(n, kept + 2 * (end - kept))
                left = self.starts(text, kept, end)
                continue
            total += int(np.count_nonzero((left >= kept) & (left < splice)))
            kept, left, end = splice, right, stop
        return total + int(np.count_nonzero(left >= kept))


@lru_cache(maxsize=4)
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives each task one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def resync_counter(path: str, chunk_chars: int, overlap_chars: int) -> ResyncCounter:
    """One per Python worker, which serves many tasks."""
    return ResyncCounter(library(path), chunk_chars, overlap_chars)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, chunk_chars: int = 16_384, overlap_chars: int = 256,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Bytes, tokens and whether the tokens exceed ``limit``, one row per document; no shuffle.

    ``tokenizer_path`` names a vocabulary file on every executor whose pre-tokenizer drops white space.
    """

    def work():
        counter = resync_counter(tokenizer_path, chunk_chars, overlap_chars)

        def function(texts: list[str]) -> dict:
            tokens = np.array(counter.counts(texts), np.int64)
            return {"n_bytes": np.array([len(t.encode()) for t in texts], np.int64), "n_tokens": tokens, "over_limit": tokens > limit}

        return function

    return map_texts(docs, id_col, text_col, work, "n_bytes long, n_tokens long, over_limit boolean")
