"""URL rules as one bit-parallel automaton.

Every rule is a glob over the canonical form ``.host/path``: ``*`` stands for bytes other than ``/``, ``**`` for any
bytes, everything else for itself. The states of all globs lie side by side in 64-bit words; one step of Shift-And per
byte (shift with carry between words, mask, self-loops of the wildcards) advances all globs over all URLs of a batch.

Defined results: a null URL and one without ``://`` have an empty host and path and match nothing; a host keeps its
port and user part; of several rules that fit the longest wins, among equal lengths the first; repeated and equal rows
are judged alike; an empty rule list gives every URL the default verdict.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlens.llm.base import small_batches

SLASH = ord("/")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first ``://`` and the path (A-Z lower-cased), and the path without query and fragment."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def host_rule(rule: str) -> str:
    """The glob of a ``host/path`` rule: the host and all its subdomains, paths that begin with the path."""
    return "*." + rule + "**"


class Automaton:
    """Globs packed into masks of 64-bit words; state 0 of a glob is its start, the last its acceptance."""

    def __init__(self, globs: list[str]):
        steps, loops, starts, ends = [None], [None], [], []  # per state: the byte that leads to it, the bytes that keep it
        for glob in globs:
            starts.append(len(steps))
            steps.append(None)
            loops.append(None)
            data, i = glob.encode(), 0
            while i < len(data):
                if data[i : i + 2] == b"**":
                    loops[-1], i = "any", i + 2
                elif data[i : i + 1] == b"*":
                    loops[-1], i = loops[-1] or "segment", i + 1
                else:
                    steps.append(data[i])
                    loops.append(None)
                    i += 1
            ends.append(len(steps) - 1)
        self.words = -(-len(steps) // 64)
        self.reach, self.stay = self._table(), self._table()
        for state, byte in enumerate(steps):
            if byte is not None:
                self._set(self.reach[byte], state)
        for state, kind in enumerate(loops):
            for byte in range(256) if kind else ():
                if kind == "any" or byte != SLASH:
                    self._set(self.stay[byte], state)
        self.start = np.zeros(self.words, np.uint64)
        for state in starts:
            self._set(self.start, state)
        self.ends = ends
        self.settled = np.zeros(self.words, np.uint64)  # accepting for good: nothing later can change them
        for state in ends:
            if loops[state] == "any":
                self._set(self.settled, state)

    def _table(self) -> np.ndarray:
        return np.zeros((256, self.words), np.uint64)

    @staticmethod
    def _set(words: np.ndarray, state: int) -> None:
        words[state // 64] |= np.uint64(1 << (state % 64))

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """One row per text, one column per glob: whether the glob matches the whole text."""
        n = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")  # long first: the texts still running are always a prefix
        begins = (np.cumsum(lengths) - lengths)[order]
        flat, sizes = np.frombuffer(b"".join(texts), np.uint8), lengths[order]
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        live = n
        for at in range(int(sizes[0]) if n else 0):
            live = int(np.searchsorted(-sizes[:live], -at, side="left"))
            now = state[:live]
            if at % 64 == 63 and not np.any(now & ~self.settled):
                break
            byte = flat[begins[:live] + at]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.reach[byte]) | (now & self.stay[byte])
        found = np.empty((n, len(self.ends)), bool)
        for k, end in enumerate(self.ends):
            found[order, k] = (state[:, end // 64] >> np.uint64(end % 64)) & one != 0
        return found


def judge_urls(
    pages: DataFrame, rules: dict[str, str], default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Host, path, deciding rule and verdict of every URL; ``rules`` maps ``host/path`` rules to verdicts.

    No shuffle: the automaton, whose size is that of the rules, travels with the tasks.
    """
    small_batches(pages.sparkSession)
    host, path = host_and_path(F.col(url_col))
    named = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    ranked = sorted(rules, key=len, reverse=True)
    labels = pa.array([*ranked, None], pa.string())
    verdicts = pa.array([*(rules[r] for r in ranked), default], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([host_rule(r) for r in ranked])
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = automaton.matches([f".{h}{p}".encode() for h, p in zip(hosts, paths)])
            first = np.where(found.any(axis=1), found.argmax(axis=1), len(ranked)) if ranked else np.zeros(len(hosts), int)
            decided = [labels.take(pa.array(first)), verdicts.take(pa.array(first))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *decided], names=["id", "host", "path", "rule", "verdict"])

    kind = named.schema["id"].dataType.simpleString()
    return named.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
