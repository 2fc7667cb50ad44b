"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

The words of a batch that were not met before lie in one flat symbol array. Each round takes the best-ranked pair of
every word (segmented minimum), merges all its occurrences of the word at once, leftmost first, compacts the array and
drops the words that have no pair left. It equals the one-by-one merging of the library exactly: of the occurrences,
those after the first whose merge makes an equally good or better pair wait for the next round.

A text is cut into words where no piece of the vocabulary can reach across: before a space mark that follows another
character, and between two characters that stand side by side in no piece.

Defined results: a null text counts as empty and has no ids; unknown characters become byte pieces; a literal space
mark (U+2581) counts as a space, as in the library; control and unknown ids decode as the library decodes them.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chatterlens.llm.base import Memory, map_texts

MARK = "▁"
KEPT_WORDS = 250_000  # words per generation whose ids a worker remembers
CODES = 0x110000
NEVER = np.int32(2**31 - 1)


def _one_by_one(error: UnicodeDecodeError):
    return "�", error.start + 1


codecs.register_error("one_by_one", _one_by_one)


class PieceModel:
    """Tables of a SentencePiece BPE model: character symbols, pair ranks, cuts, and the bytes of every piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)])
        normal = {p: i for i, p in enumerate(pieces) if not special[i]}
        probe = " a\t ﬁéé ① "
        if model.normalize(probe).replace(MARK, " ") != " " + probe or any(model.is_unused(i) for i in range(size)):
            raise ValueError("only models with the identity normalizer, a dummy prefix and all pieces in use are supported")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in normal):
            raise ValueError("a piece reaches across a space")
        self.size = size
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        # Symbols: a piece is its id; a character without a piece is size + code point.
        self.symbol_of = np.arange(size, size + CODES, dtype=np.int64)
        for piece, i in normal.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        self.base = size + CODES
        scores = {p: model.get_score(i) for p, i in normal.items()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                left, right = self._symbol(piece[:k], normal), self._symbol(piece[k:], normal)
                if left is not None and right is not None:
                    pairs[left * self.base + right] = (order[scores[piece]], i)
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.int64(2**63 - 1))
        self.rank = np.array([*(pairs[k][0] for k in keys.tolist()), NEVER], np.int32)
        self.merged = np.array([*(pairs[k][1] for k in keys.tolist()), 0], np.int64)
        inside = {ord(p[k]) * CODES + ord(p[k + 1]) for p in normal for k in range(len(p) - 1)}
        self.inside = np.array([*sorted(inside), 2**62], np.int64)
        self.newline = not any("\n" in p for p in normal)
        runs = sorted(len(p) for p in normal if set(p) == {MARK} and len(p) > 1)
        last = len(order) - 1
        mixed = any(p.startswith(MARK * 2) and set(p) != {MARK} for p in normal) or sum(order[x] == last for q, x in scores.items() if q != MARK) != len(runs)
        self.run = runs[-1] if runs and not mixed else 0
        surface = []
        for i, piece in enumerate(pieces):
            if model.is_control(i):
                surface.append(b"")
            elif model.is_unknown(i):
                surface.append(model.decode([i]).encode())
            elif model.is_byte(i):
                surface.append(bytes([int(piece[3:5], 16)]))
            else:
                surface.append(piece.replace(MARK, " ").encode())
        self.silent = np.array([model.is_control(i) for i in range(size)])
        self.spaced = np.array([not special[i] and pieces[i].startswith(MARK) for i in range(size)])
        self.width = np.array([len(s) for s in surface], np.int64)
        self.offset = np.cumsum(self.width) - self.width
        self.surface = np.frombuffer(b"".join(surface), np.uint8)

        # Marks merge last and leftmost first, so a long run begins with full-length pieces; seen to hold before it is used.
        if self.run and not all(self._run_splits(k) for k in range(self.run + 1, 4 * self.run)):
            self.run = 0

    def _run_splits(self, k: int) -> bool:
        whole, head, tail = (self.merge_words([MARK * n])[0].tolist() for n in (k, self.run, k - self.run))
        return len(head) == 1 and whole == head + tail

    def _symbol(self, text: str, normal: dict[str, int]) -> int | None:
        return normal.get(text, self.size + ord(text) if len(text) == 1 else None)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NEVER), self.merged[at]

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(codes):
            return np.empty(0, np.int64), lengths
        last = np.zeros(len(codes), bool)  # the last symbol of a stretch within which merges can happen
        last[np.cumsum(lengths)[lengths > 0] - 1] = True
        beside = codes[:-1] * CODES + codes[1:]
        last[:-1] |= self.inside[np.searchsorted(self.inside, beside)] != beside
        symbols, place = self.symbol_of[codes], np.arange(len(codes))
        done_symbols, done_places = [], []
        rank, into = self._ranked(symbols, last)
        while len(symbols):
            starts = np.flatnonzero(np.append(True, last[:-1]))
            sizes = np.diff(np.append(starts, len(symbols)))
            best = np.minimum.reduceat(rank, starts)
            over = best == NEVER
            if over.any():
                out = np.repeat(over, sizes)
                done_symbols.append(symbols[out])
                done_places.append(place[out])
                symbols, place, last, rank, into = (x[~out] for x in (symbols, place, last, rank, into))
                starts, sizes, best = None, sizes[~over], best[~over]
                if not len(symbols):
                    break
            stretch = np.repeat(np.arange(len(sizes)), sizes)
            best = best[stretch]
            at = self._leftmost(np.flatnonzero(rank == best))
            at = at[self._in_turn(at, stretch, symbols, last, into, best)]
            symbols[at] = into[at]
            last[at] = last[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # places of the merged symbols after compaction
            symbols, place, last, rank, into = (x[keep] for x in (symbols, place, last, rank, into))
            beside = moved[np.append(True, np.diff(moved) > 1) & (moved > 0)] - 1
            fresh = np.concatenate([moved, beside])
            rank[fresh], into[fresh] = self._ranked_at(symbols, last, fresh)
        flat, order = np.concatenate(done_symbols), np.argsort(np.concatenate(done_places), kind="stable")
        first_char = np.concatenate(done_places)[order]
        word = np.searchsorted(np.cumsum(lengths), first_char, side="right")
        return self._ids(flat[order], word, len(words))

    def _ranked(self, symbols: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._ranked_at(symbols, last, np.arange(len(symbols)))

    def _ranked_at(self, symbols: np.ndarray, last: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, into = self._pairs(symbols[at], symbols[np.minimum(at + 1, len(symbols) - 1)])
        return np.where(last[at], NEVER, rank), into

    @staticmethod
    def _leftmost(at: np.ndarray) -> np.ndarray:
        """Of overlapping occurrences (neighbouring places) every second one, from the left."""
        new = np.append(True, np.diff(at) != 1)
        begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        return at[(np.arange(len(at)) - begin) % 2 == 0]

    def _in_turn(self, at, stretch, symbols, last, into, best) -> np.ndarray:
        """Which occurrences may merge now: up to the first, per stretch, that makes a pair as good as the present one."""
        made = into[at]
        follows = np.append(False, at[1:] == at[:-1] + 2)  # right behind another occurrence
        before = np.maximum(at - 1, 0)
        has_left = (at > 0) & ~last[before]
        left = np.where(follows, np.append(0, made[:-1]), symbols[before])
        left_rank = np.where(has_left, self._pairs(left, made)[0], NEVER)
        after = np.minimum(at + 2, len(symbols) - 1)
        right_rank = np.where(last[at + 1], NEVER, self._pairs(made, symbols[after])[0])
        stops = (np.minimum(left_rank, right_rank) <= best[at]).astype(np.int64)
        earlier = np.cumsum(stops) - stops
        new = np.append(True, stretch[at][1:] != stretch[at][:-1])
        return earlier == np.maximum.accumulate(np.where(new, earlier, 0))

    def _ids(self, symbols: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids; a character without a piece becomes the ids of its UTF-8 bytes."""
        unknown = np.flatnonzero(symbols >= self.size)
        if not len(unknown):
            return symbols, np.bincount(word, minlength=n)
        encoded = [chr(c).encode() for c in (symbols[unknown] - self.size).tolist()]
        widths = np.ones(len(symbols), np.int64)
        widths[unknown] = [len(e) for e in encoded]
        ids = np.repeat(symbols, widths)
        ids[ids >= self.size] = self.byte_id[np.frombuffer(b"".join(encoded), np.uint8)]
        return ids, np.bincount(np.repeat(word, widths), minlength=n)

    def words(self, text: str) -> list[str]:
        """The text with its dummy prefix, cut before every run of space marks and before line ends; see literal()."""
        if not text:
            return []
        marked = text.replace(" ", MARK)
        parts = (marked.replace("\n", MARK + "\n") if self.newline else marked).split(MARK)
        if "" not in parts:
            return parts if parts[0][0] != "\n" else [MARK, *parts]
        found = []
        for run, rest in re.findall(f"({MARK}+)([^{MARK}]*)", MARK + marked):
            if self.run and len(run) > self.run:
                full = (len(run) - 1) // self.run
                found += [MARK * self.run] * full
                run = run[full * self.run :]
            found.append(rest if len(run) == 1 and rest and rest[0] != "\n" else run + rest)
        return found

    @staticmethod
    def literal(word: str) -> str:
        """A word's characters: those that begin with neither a mark nor a line end stood behind a single mark."""
        return word if word[0] in (MARK, "\n") else MARK + word

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, as the library's decode gives it."""
        ids = np.asarray(ids, np.int64)
        silent = self.silent[ids]
        spoken = ids[~silent]
        strip = 1 if len(spoken) and self.spaced[spoken[0]] else 0
        # Control ids are silent, but the bytes on their two sides don't form a character.
        runs = np.split(spoken, np.unique(np.cumsum(~silent)[silent])) if silent.any() else [spoken]
        return "".join(self._bytes(run).decode("utf-8", "one_by_one") for run in runs)[strip:]

    def _bytes(self, ids: np.ndarray) -> bytes:
        widths = self.width[ids]
        ends = np.cumsum(widths)
        return self.surface[np.arange(int(widths.sum())) + np.repeat(self.offset[ids] - (ends - widths), widths)].tobytes()


class PieceEncoder:
    """Encodes texts; remembers the ids of common words."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.words = Memory(KEPT_WORDS)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bytes]]:
        """Ids of every text, as numbers and as decimals joined by commas."""
        cut = [self.model.words(t) for t in texts]
        new = self.words.missing(chain.from_iterable(cut))
        ids, counts = self.model.merge_words([self.model.literal(w) for w in new])
        ends = np.cumsum(counts).tolist()
        decimal = list(map(str, ids.tolist()))
        raw = ids.astype(np.int32)
        known = self.words.now
        begin = 0
        for word, end in zip(new, ends):
            known[word] = (raw[begin:end].tobytes(), ",".join(decimal[begin:end]).encode())
            begin = end
        made = []
        for ws in cut:
            found = [known[w] for w in ws]
            made.append((np.frombuffer(b"".join([f[0] for f in found]), np.int32), b",".join([f[1] for f in found])))
        self.words.settle(new)
        return made


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One per Python worker, which serves many tasks."""
    return PieceEncoder(PieceModel(path))


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text per document; with ``with_ids`` also ids and text.

    No shuffle. ``model_path`` names the model file on every executor.
    """

    def work():
        coder = encoder(model_path)

        def function(texts: list[str]) -> dict:
            made = coder.encode(texts)
            decoded = [coder.model.decode(ids) for ids, _ in made]
            out = {
                "n_tokens": np.array([len(ids) for ids, _ in made], np.int64),
                "ids_sha256": [hashlib.sha256(decimal).hexdigest() for _, decimal in made],
                "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for d in decoded],
            }
            return out | ({"ids": pa.array([ids for ids, _ in made], pa.list_(pa.int32())), "decoded": decoded} if with_ids else {})

        return function

    return map_texts(docs, id_col, text_col, work, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)
