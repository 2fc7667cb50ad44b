"""Words of whole batches of texts as flat numpy arrays over UTF-8 bytes.

Every class of bytes used here is ASCII or all of the non-ASCII bytes, so cutting bytes never cuts a character.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_class(members: Iterable[int]) -> np.ndarray:
    """A table of 256 flags."""
    flags = np.zeros(256, bool)
    flags[list(members)] = True
    return flags


def lowered(text: bytes) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return LOWER[np.frombuffer(text, np.uint8)]


class Words:
    """The maximal runs of bytes of a class: where they start and end, and their bytes as one Arrow array."""

    def __init__(self, raw: np.ndarray, inside: np.ndarray):
        marks = inside[raw]
        edges = np.flatnonzero(np.diff(marks, prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        offsets = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=offsets[1:])
        self.array = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[marks])])

    def __len__(self) -> int:
        return len(self.starts)
