"""The search for the number of blocks: a bracket of three candidates, narrowed by the golden section."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

GOLDEN = 0.618


@dataclass
class Candidate:
    blocks: int
    mdl: float
    model: Any = None


@dataclass
class Bracket:
    """Candidates by number of blocks around the middle one.

    ``many`` has more blocks than ``middle`` and ``few`` fewer; a side that isn't known is None.  Bottom-up search starts with many
    blocks and shrinks by ``rate`` until a worse candidate bounds it below; top-down search starts with one and grows by ``rate`` until
    a worse one bounds it above, and a candidate becomes the middle only if its number of blocks differs by more than a tenth.  Then
    the larger gap is cut at the golden section until no number is left in it.  ``best`` is the shortest of all that were added.
    """

    grow: bool = False
    rate: float = 0.5
    best: Candidate | None = None
    middle: Candidate | None = None
    many: Candidate | None = None
    few: Candidate | None = None
    tried: dict[int, float] = field(default_factory=dict)

    def add(self, c: Candidate) -> None:
        self.tried[c.blocks] = c.mdl
        if self.best is None or c.mdl <= self.best.mdl:
            self.best = c
        old = self.middle
        if old is None:
            self.middle = c
        elif c.mdl <= old.mdl and (not self.grow or abs(c.blocks - old.blocks) > 0.1 * old.blocks):
            if old.blocks > c.blocks:
                self.many = old
            elif old.blocks < c.blocks:
                self.few = old
            self.middle = c
        elif c.blocks > old.blocks:
            self.many = c
        elif c.blocks < old.blocks:
            self.few = c

    @property
    def bounded(self) -> bool:
        return (self.many if self.grow else self.few) is not None

    @property
    def done(self) -> bool:
        """Whether no number of blocks is left between the sides."""
        if self.many is not None and self.few is not None:
            return self.many.blocks - self.few.blocks <= 2
        side = self.many or self.few
        return abs(side.blocks - self.middle.blocks) <= 1

    def next(self) -> tuple[Candidate, int] | None:
        """(candidate to start from, number of blocks to try), or None when the search is done."""
        if self.middle is None:
            raise ValueError("nothing was tried yet")
        if not self.bounded:
            b = self.middle.blocks
            to = math.ceil(b * self.rate) if self.grow else b - int(b * self.rate)
            if self.grow and to <= b:
                to = b + 1
            return (self.middle, to) if to != b and to >= 1 else None
        if self.done:
            return None
        above = self.many.blocks - self.middle.blocks if self.many else 0
        below = self.middle.blocks - self.few.blocks if self.few else 0
        gaps = [(self.many, self.middle), (self.middle, self.few)]
        for hi, lo in gaps if above >= below else gaps[::-1]:
            left = [b for b in range(lo.blocks + 1, hi.blocks) if b not in self.tried] if hi and lo else []
            if left:
                to = lo.blocks + int((hi.blocks - lo.blocks) * GOLDEN)
                return (lo if self.grow else hi), min(left, key=lambda b: (abs(b - to), b))
        return None


def should_stop(changes: list[float], start: float, bounded: bool, moves: list[int] | None = None) -> bool:
    """Whether sweeps have settled.

    No change or move at all; the last three changes on average under 5e-4 (1e-4 once bounded) of the start; or more moves in the last
    sweep than in each of the three before it.
    """
    if changes and changes[-1] == 0 or moves and moves[-1] == 0:
        return True
    if len(changes) < 3:
        return False
    if -sum(changes[-3:]) / 3 < (1e-4 if bounded else 5e-4) * start:
        return True
    return moves is not None and len(moves) > 3 and moves[-1] > max(moves[-4:-1])
