"""Box geometry as column expressions: flat integer columns, so that joins on them are compiled as a whole.

A box is four columns x, y (top left), w, h, each with a prefix."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def cx(self) -> Column:
        return self.x + self.w / 2

    @property
    def cy(self) -> Column:
        return self.y + self.h / 2


def box(prefix: str = "", table: str = "") -> Box:
    """Columns {prefix}x, {prefix}y, {prefix}w, {prefix}h, of an aliased table if given."""
    at = f"{table}." if table else ""
    return Box(*[F.col(f"{at}{prefix}{c}") for c in "xywh"])


def area(b: Box) -> Column:
    return F.greatest(b.w, F.lit(0)) * F.greatest(b.h, F.lit(0))


def intersection(a: Box, b: Box) -> Column:
    wide = F.least(a.right, b.right) - F.greatest(a.x, b.x)
    high = F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def coverage(inner: Box, outer: Box) -> Column:
    """Share of the inner box's area within the outer; 0 for a box without area."""
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(0.0)


def smaller_coverage(a: Box, b: Box) -> Column:
    """Intersection over the smaller of the two areas."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def center_within(inner: Box, outer: Box) -> Column:
    """Borders belong to the outer box."""
    return inner.cx.between(outer.x, outer.right) & inner.cy.between(outer.y, outer.bottom)


def contains(outer: Box, inner: Box) -> Column:
    return (outer.x <= inner.x) & (outer.y <= inner.y) & (inner.right <= outer.right) & (inner.bottom <= outer.bottom)


def vertical_gap(a: Box, b: Box) -> Column:
    """Free rows between two boxes; -1 where they overlap."""
    return F.when(b.y >= a.bottom, b.y - a.bottom).when(a.y >= b.bottom, a.y - b.bottom).otherwise(-1)


def side_overlap(a: Box, b: Box) -> Column:
    """Common width over the narrower width."""
    narrow = F.least(a.w, b.w)
    wide = F.greatest(F.least(a.right, b.right) - F.greatest(a.x, b.x), F.lit(0))
    return F.when(narrow > 0, wide / narrow).otherwise(0.0)
