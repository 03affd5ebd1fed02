"""An index of boxes for folds over one page: squares whose side suits each box's size, so that a box lies in four of them at most."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np


#: So many items are not worth an index.
FEW = 24


class Grid:
    """Items by box (x, y, w, h). `near` gives all items whose box may touch the one asked for, and others close by; items up to `few` are all close."""

    def __init__(self, few: int = FEW):
        self.most = few
        self.few: dict | None = {}
        self.levels: dict[int, dict[tuple[int, int], list]] = {}

    @staticmethod
    def _range(box: Sequence[float], side: int) -> tuple[int, int, int, int]:
        x, y, w, h = box
        return math.floor(x / side), math.floor((x + max(w, 0)) / side), math.floor(y / side), math.floor((y + max(h, 0)) / side)

    def add(self, item, box: Sequence[float]) -> None:
        if self.few is not None:
            self.few.setdefault(item, []).append(box)
            if len(self.few) <= self.most:
                return
            held, self.few = self.few, None
            for k, boxes in held.items():
                for b in boxes:
                    self._put(k, b)
            return
        self._put(item, box)

    def _put(self, item, box: Sequence[float]) -> None:
        level = max(0, math.ceil(math.log2(max(box[2], box[3], 1))))
        cells = self.levels.setdefault(level, {})
        a, b, c, d = self._range(box, 1 << level)
        for i in range(a, b + 1):
            for k in range(c, d + 1):
                cells.setdefault((i, k), []).append(item)

    def near(self, box: Sequence[float]) -> set:
        if self.few is not None:
            return set(self.few)
        found: set = set()
        for level, cells in self.levels.items():
            a, b, c, d = self._range(box, 1 << level)
            if (b - a + 1) * (d - c + 1) > len(cells):
                for (i, k), items in cells.items():
                    if a <= i <= b and c <= k <= d:
                        found.update(items)
                continue
            for i in range(a, b + 1):
                for k in range(c, d + 1):
                    if items := cells.get((i, k)):
                        found.update(items)
        return found


#: Groups of so many boxes are compared as a whole; in larger ones the index is asked.
SMALL = 128


def near_pairs(group_a: np.ndarray, a: Sequence[np.ndarray], group_b: np.ndarray, b: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and in b of all pairs of one group whose boxes may touch, and of others, in parts; all pairs of a box of a are in one part, one
    after the other. Boxes are arrays x, y, w, h and lie in order of their groups' numbers."""
    lo, hi = np.searchsorted(group_b, group_a, "left"), np.searchsorted(group_b, group_a, "right")
    many = hi - lo
    small = np.flatnonzero((many > 0) & (many <= SMALL))
    for k in range(0, len(small), 8192):  # a million pairs at most
        at = small[k : k + 8192]
        n = many[at]
        before = np.cumsum(n) - n
        yield np.repeat(at, n), np.arange(n.sum()) - np.repeat(before - lo[at], n)
    large = np.flatnonzero(many > SMALL)
    for first in np.flatnonzero(np.diff(group_a[large], prepend=-1)):
        own = large[group_a[large] == group_a[large[first]]]
        start, end = int(lo[own[0]]), int(hi[own[0]])
        index = Grid(0)
        for k, where in enumerate(zip(*(c[start:end].tolist() for c in b), strict=True), start):
            index.add(k, where)
        for i, where in zip(own.tolist(), zip(*(c[own].tolist() for c in a), strict=True), strict=True):
            found = np.fromiter(index.near(where), np.int64)
            yield np.full(len(found), i), found
