"""Merges of a model that is held, one after the other, each with the change that it makes at its turn."""

from __future__ import annotations

import heapq
import math

import numpy as np

from .cells import Cells


class MergeQueue:
    """A heap of candidate merges (a into b), at most one a block, on a model that changes with each merge taken.

    A candidate's change of the length depends on the cells that a and b share with other blocks.  A merge of p into q alters it in two
    ways only: candidates that touch q are scored anew, and those whose two blocks both have cells with p or q by the terms of these
    cells.  Their older entries in the heap are stale and are passed over when they come up, so the least entry that isn't stale is
    what a scan of all candidates would find.
    """

    def __init__(self, cells: Cells):
        b = cells.blocks
        self.cells, self.blocks, self.parametric = cells, b, cells.parametric
        self.row: list[dict[int, float]] = [{} for _ in range(b)]
        self.col: list[dict[int, float]] = [{} for _ in range(b)]
        for key, m in zip(cells.key.tolist(), cells.m.tolist(), strict=True):
            r, s = divmod(key, b)
            self.row[r][s] = self.col[s][r] = m
        self.d_out, self.d_in, self.n = cells.d_out.tolist(), cells.d_in.tolist(), cells.n.tolist()
        self.root = list(range(b))
        self.aim: dict[int, int] = {}  # a's b
        self.aimed: list[set[int]] = [set() for _ in range(b)]
        self.change: dict[int, float] = {}
        self.heap: list[tuple[float, int, int]] = []

    def _f(self, m: float) -> float:
        if self.parametric:
            return -m * math.log(m) if m > 0 else 0.0
        return -math.lgamma(m + 1)

    def _block(self, out: float, into: float, n: int) -> float:
        if self.parametric:
            return (out * math.log(out) if out > 0 else 0.0) + (into * math.log(into) if into > 0 else 0.0)
        return (out + into) * math.log(max(n, 1)) - math.lgamma(n + 1)

    def _both(self, x: float, y: float) -> float:
        return self._f(x + y) - self._f(x) - self._f(y) if x and y else 0.0

    def score(self, a: int, b: int) -> float:
        """The change of the length, but for the part that depends on the number of blocks alone."""
        total = 0.0
        for lines in (self.row, self.col):
            x, y = lines[a], lines[b]
            if len(y) < len(x):
                x, y = y, x
            total += sum(self._both(m, y[t]) for t, m in x.items() if t in y and t != a and t != b)
        corner = [self.row[a].get(a, 0.0), self.row[a].get(b, 0.0), self.row[b].get(a, 0.0), self.row[b].get(b, 0.0)]
        total += self._f(sum(corner)) - sum(map(self._f, corner))
        o, i, n = self.d_out, self.d_in, self.n
        return total + self._block(o[a] + o[b], i[a] + i[b], n[a] + n[b]) - self._block(o[a], i[a], n[a]) - self._block(o[b], i[b], n[b])

    def _push(self, a: int, change: float) -> None:
        self.change[a] = change
        heapq.heappush(self.heap, (change, a, self.aim[a]))

    def add(self, a: int, b: int) -> None:
        """A candidate; a block has one at most."""
        self.aim[a] = b
        self.aimed[b].add(a)
        self._push(a, self.score(a, b))

    def _drop(self, a: int) -> None:
        self.aimed[self.aim.pop(a)].discard(a)
        del self.change[a]

    def _merge(self, p: int, q: int) -> None:
        self._drop(p)
        for a in list(self.aimed[p]):  # what was to go into p goes into q
            self._drop(a)
            if a != q:
                self.aim[a] = q
                self.aimed[q].add(a)
        near = (set(self.row[p]) | set(self.col[p]) | set(self.row[q]) | set(self.col[q])) - {p, q}
        pairs = [(a, self.aim[a]) for a in near if self.aim.get(a) in near]
        before = [sum(self._both(lines[a].get(t, 0.0), lines[b].get(t, 0.0)) for lines in (self.row, self.col) for t in (p, q)) for a, b in pairs]
        for lines, others in ((self.row, self.col), (self.col, self.row)):
            for t, m in list(lines[p].items()):
                if t == p:
                    continue
                del others[t][p]
                lines[q][t] = others[t][q] = lines[q].get(t, 0.0) + m
            own = lines[p].get(p)
            lines[p] = {} if own is None else {p: own}
        # what is left of p is its own cell; the cells with q now lie on q's diagonal
        own = self.row[p].get(p, 0.0)
        if own:
            self.row[q][q] = self.col[q][q] = self.row[q].get(q, 0.0) + own
        self.row[p], self.col[p] = {}, {}
        for x in (self.d_out, self.d_in, self.n):
            x[q] += x[p]
            x[p] = 0
        self.root[p] = q
        for (a, b), old in zip(pairs, before, strict=True):
            self._push(a, self.change[a] - old + sum(self._both(lines[a].get(q, 0.0), lines[b].get(q, 0.0)) for lines in (self.row, self.col)))
        for a in {q, *self.aimed[q]}:
            if a in self.aim:
                self._push(a, self.score(a, self.aim[a]))

    def take(self, merges: int) -> list[tuple[int, int, float]]:
        """Up to ``merges`` merges (a, b, change), the least change of all candidates first; ties to the smaller a."""
        done = []
        while self.heap and len(done) < merges:
            change, a, b = heapq.heappop(self.heap)
            if self.aim.get(a) != b or self.change[a] != change:
                continue
            left = self.blocks - len(done)
            done.append((a, b, change + self.cells.model_term(left - 1) - self.cells.model_term(left)))
            self._merge(a, b)
        return done

    def roots(self) -> np.ndarray:
        """The block that each has become a part of."""
        out = self.root[:]
        for x in range(len(out)):
            while out[x] != out[out[x]]:
                out[x] = out[out[x]]
        return np.array(out)
