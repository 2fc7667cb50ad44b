"""A multiway hyperplane tree over one block of vectors, with distance ranges between siblings.

Inner products are no distance; every vector x gets one more component sqrt(M^2 - |x|^2), M the greatest length of all,
and a query a zero there. Then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so a window of scores is an annulus of distances around
the query. A node splits its rows by the nearest of some of them; for every split point and every child it keeps the
least and the greatest distance from the point to the child's rows. By the triangle inequality a child whose range
cannot meet the annulus, seen from any of the split points, is left out. Leaves are scored exactly in integers.
"""

from __future__ import annotations

import io
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

FAN = 8  # children of a node
LEAF = 128
SLACK = 1e-5  # of M: what rounding may do to a distance


def lift(rows: np.ndarray, square: int) -> np.ndarray:
    """The rows with the component that gives all of them the same length."""
    whole = rows.astype(np.float64)
    return np.column_stack([whole, np.sqrt(np.maximum(0.0, square - (whole * whole).sum(axis=1)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, square))


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n places of distinct points, each the farthest from those before it."""
    chosen = [0]
    nearest = distances(points, points[:1])[:, 0]
    while len(chosen) < n and nearest.max(initial=0.0) > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(points, points[chosen[-1:]])[:, 0])
        nearest[chosen] = 0
    return np.array(chosen)


@dataclass
class Tree:
    """Rows in tree order, and the nodes as flat arrays; node 0 is the root."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    spans: list = field(default_factory=list)  # (first row, end, first child)
    points: list = field(default_factory=list)  # per node: lifted split points, empty for a leaf
    ranges: list = field(default_factory=list)  # per node: least and greatest distance, point x child
    converted: np.ndarray | None = None

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, square: int) -> Tree:
        lifted = lift(rows, square)
        tree = cls(ids, labels, rows)
        order = np.arange(len(ids))
        tree.spans.append([0, len(ids), 0])
        node = 0
        while node < len(tree.spans):
            start, end, _ = tree.spans[node]
            here = order[start:end]
            split, parts = cls._split(lifted, here) if end - start > LEAF else (None, [])
            if len(parts) > 1:
                tree.points.append(lifted[split])
                apart = distances(lifted[split], lifted[here])
                tree.ranges.append(np.stack([[[f(apart[i, p]) for p in parts] for i in range(len(split))] for f in (np.min, np.max)]))
                tree.spans[node][2] = len(tree.spans)
                order[start:end] = np.concatenate([here[p] for p in parts])
                for part in parts:
                    tree.spans.append([start, start + len(part), 0])
                    start += len(part)
            else:
                tree.points.append(np.empty((0, lifted.shape[1])))
                tree.ranges.append(np.empty((2, 0, 0)))
            node += 1
        tree.ids, tree.labels, tree.rows = ids[order], labels[order], rows[order]
        return tree

    def numbers(self, kind: type) -> np.ndarray:
        """The rows as numbers of one kind, converted once."""
        if self.converted is None or self.converted.dtype != kind:
            self.converted = self.rows.astype(kind)
        return self.converted

    @staticmethod
    def _split(lifted: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        some = here[:: max(1, len(here) // 256)]
        split = some[far_apart(lifted[some], FAN)]
        nearest = distances(lifted[here], lifted[split]).argmin(axis=1)
        parts = [np.flatnonzero(nearest == j) for j in range(len(split))]
        return split, [p for p in parts if len(p)]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        wide = self.points[0].shape[1]
        np.savez(
            out, ids=self.ids, labels=self.labels, rows=self.rows, spans=np.array(self.spans), sizes=[r.shape[1:] for r in self.ranges],
            points=np.concatenate(self.points).reshape(-1, wide), ranges=np.concatenate([r.ravel() for r in self.ranges]),
        )
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw)) as f:
            sizes = f["sizes"]
            points = np.split(f["points"], np.cumsum(sizes[:, 0])[:-1])
            flat = np.split(f["ranges"], np.cumsum(2 * sizes.prod(axis=1))[:-1])
            ranges = [r.reshape(2, *s) for r, s in zip(flat, sizes)]
            return cls(f["ids"], f["labels"], f["rows"], f["spans"].tolist(), points, ranges)


def reachable(to_points: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible distance from each query to each child, seen from all split points."""
    least, greatest = ranges
    seen = to_points[:, :, None]
    return np.maximum(seen - greatest, least - seen).max(axis=1), (seen + greatest).min(axis=1)


class Search:
    """The k best rows for slots of queries: a slot belongs to a query and wants scores from ``low`` to ``high``.

    ``same_label`` says whether rows of the query's label are wanted, or only rows of others. Rows of the query's own id
    never count. The best rows found so far are kept while blocks are visited, and narrow the annulus.
    """

    NONE = np.iinfo(np.int64).min

    def __init__(self, ids, labels, rows, slot_query, low, high, k: int, same_label: bool, square: int, exact_in_floats: bool):
        self.ids, self.labels, self.rows, self.square = ids, labels, rows, square
        self.same_label, self.k = same_label, k
        self.as_number = np.float64 if exact_in_floats else np.int64
        self.lifted = np.column_stack([rows.astype(np.float64), np.zeros(len(rows))])
        self.base = (self.lifted * self.lifted).sum(axis=1) + float(square)
        self.slack = SLACK * max(1.0, float(np.sqrt(float(square))))
        # The slots of a query stand together.
        order = np.argsort(slot_query, kind="stable")
        self.slot_order, self.slot_query, self.low, self.high = order, slot_query[order], low[order], high[order]
        self.n_slots = np.bincount(self.slot_query, minlength=len(ids))
        self.first_slot = np.cumsum(self.n_slots) - self.n_slots
        self.numbers = rows.astype(self.as_number)
        self.scores = np.full((len(slot_query), k), self.NONE)
        self.found = np.zeros((len(slot_query), k), np.int64)
        self.scored = 0
        self.near, self.far = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
        self.least, self.most = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        self._set_bounds(np.arange(len(ids)))

    def _set_bounds(self, queries: np.ndarray) -> None:
        """What a slot of each query may still take: the window of scores and the annulus of distances."""
        touched = np.zeros(len(self.ids), bool)
        touched[queries] = True
        slots = np.flatnonzero(touched[self.slot_query])
        mine = self.slot_query[slots]
        self.least[queries], self.most[queries] = np.iinfo(np.int64).max, self.NONE
        np.minimum.at(self.least, mine, np.maximum(self.low[slots], self.scores[slots, -1]))
        np.maximum.at(self.most, mine, self.high[slots])
        least, most, base = self.least[queries], self.most[queries], self.base[queries]
        self.far[queries] = self.slack + np.where(least == self.NONE, np.inf, np.sqrt(np.maximum(0.0, base - 2.0 * least)))
        self.near[queries] = np.sqrt(np.maximum(0.0, base - 2.0 * most)) - self.slack

    def through(self, queries: np.ndarray, least: np.ndarray, greatest: np.ndarray, trees: Sequence[Tree]) -> None:
        """Search the trees whose distances the annuli meet: every query its nearest tree first, which narrows its annulus."""
        home = least.argmin(axis=1)
        for first in (True, False):
            for j, tree in enumerate(trees):
                wanted = (home == j) == first
                wanted &= (least[:, j] <= self.far[queries]) & (greatest[:, j] >= self.near[queries])
                if wanted.any():
                    self.search(tree, queries[wanted])

    def search(self, tree: Tree, queries: np.ndarray) -> None:
        """All of one tree: first the leaf where each query would lie, then the rest that the annuli meet."""
        self.done = np.full(len(self.ids), -1)
        self._home(tree, queries, 0)
        self._visit(tree, queries, 0)

    def _reachable(self, tree: Tree, queries: np.ndarray, node: int) -> tuple[np.ndarray, np.ndarray]:
        return reachable(distances(self.lifted[queries], tree.points[node]), tree.ranges[node])

    def _home(self, tree: Tree, queries: np.ndarray, node: int) -> None:
        child = tree.spans[node][2]
        if not child:
            self._leaf(tree, queries, node)
            self.done[queries] = node
            return
        nearest = self._reachable(tree, queries, node)[0].argmin(axis=1)
        for j in np.unique(nearest):
            self._home(tree, queries[nearest == j], child + int(j))

    def _visit(self, tree: Tree, queries: np.ndarray, node: int) -> None:
        child = tree.spans[node][2]
        if not child:
            if len(rest := queries[self.done[queries] != node]):
                self._leaf(tree, rest, node)
            return
        least, greatest = self._reachable(tree, queries, node)
        for j in range(least.shape[1]):
            wanted = (least[:, j] <= self.far[queries]) & (greatest[:, j] >= self.near[queries])
            if wanted.any():
                self._visit(tree, queries[wanted], child + j)

    def _leaf(self, tree: Tree, queries: np.ndarray, node: int) -> None:
        some = slice(*tree.spans[node][:2])
        self.scored += len(queries) * (some.stop - some.start)
        scores = (self.numbers[queries] @ tree.numbers(self.as_number)[some].T).astype(np.int64)
        able = (scores >= self.least[queries][:, None]) & (scores <= self.most[queries][:, None])
        able &= (tree.labels[some][None] == self.labels[queries][:, None]) == self.same_label
        at, which = np.nonzero(able)
        other = tree.ids[some][which] != self.ids[queries[at]]
        at, which = at[other], which[other]
        if not len(at):
            return
        # The few rows left, once for every slot of their query.
        each = self.n_slots[queries[at]]
        slot = np.repeat(self.first_slot[queries[at]] - np.cumsum(each) + each, each) + np.arange(each.sum())
        at, which = np.repeat(at, each), np.repeat(which, each)
        score = scores[at, which]
        fits = (score >= np.maximum(self.low[slot], self.scores[slot, -1])) & (score <= self.high[slot])
        if fits.any():
            self._take(slot[fits], score[fits], tree.ids[some][which[fits]])

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, id, score) of all that was found; slots as they were given."""
        slot, rank = np.nonzero(self.scores != self.NONE)
        return self.slot_order[slot], self.found[slot, rank], self.scores[slot, rank]

    def _take(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(slots)
        old_slot = np.repeat(touched, self.k)
        old_score, old_id = self.scores[touched].ravel(), self.found[touched].ravel()
        there = old_score != self.NONE
        slot = np.concatenate([old_slot[there], slots])
        score, found = np.concatenate([old_score[there], scores]), np.concatenate([old_id[there], ids])
        order = np.lexsort((found, -score, slot))
        slot, score, found = slot[order], score[order], found[order]
        start = np.searchsorted(slot, slot)
        rank = np.arange(len(slot)) - start
        keep = rank < self.k
        self.scores[touched] = self.NONE
        self.scores[slot[keep], rank[keep]] = score[keep]
        self.found[slot[keep], rank[keep]] = found[keep]
        self._set_bounds(np.unique(self.slot_query[touched]))
