"""Boxes and polygons as JVM expressions; a box is an array x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def side(box: Column | str, i: int) -> Column:
    return F.get(_c(box), F.lit(i))


def clip(box: Column | str, width: Column, height: Column) -> Column:
    """Whole-numbered corners within the page, halves to even."""
    edge = lambda i, most: F.greatest(F.lit(0), F.least(most.cast("long"), F.bround(side(box, i)).cast("long")))
    return F.array(edge(0, width), edge(1, height), edge(2, width), edge(3, height))


def area(box: Column | str) -> Column:
    return F.greatest(F.lit(0), side(box, 2) - side(box, 0)) * F.greatest(F.lit(0), side(box, 3) - side(box, 1))


def overlap(a: Column | str, b: Column | str) -> Column:
    """Area that two boxes share."""
    wide = F.least(side(a, 2), side(b, 2)) - F.greatest(side(a, 0), side(b, 0))
    high = F.least(side(a, 3), side(b, 3)) - F.greatest(side(a, 1), side(b, 1))
    return F.greatest(F.lit(0), wide) * F.greatest(F.lit(0), high)


def iou(a: Column | str, b: Column | str) -> Column:
    shared = overlap(a, b)
    whole = area(a) + area(b) - shared
    return F.when(whole > 0, shared / whole).otherwise(F.lit(0.0))


def contains(outer: Column | str, inner: Column | str, ratio: float = 0.95) -> Column:
    """Whether at least ``ratio`` of the inner box lies in the outer."""
    return (area(inner) > 0) & (overlap(outer, inner) / area(inner) >= ratio)


def polygon_box(poly: Column | str) -> Column:
    """The box around an array of points."""
    xs, ys = F.transform(_c(poly), lambda p: F.get(p, F.lit(0))), F.transform(_c(poly), lambda p: F.get(p, F.lit(1)))
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
