"""Boxes and scores. A box is a struct or a prefix's columns x1, y1, x2, y2."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))

    @property
    def width(self) -> Column:
        return F.greatest(self.x2 - self.x1, F.lit(0.0))

    @property
    def height(self) -> Column:
        return F.greatest(self.y2 - self.y1, F.lit(0.0))

    @property
    def middle(self) -> Column:
        return (self.y1 + self.y2) / 2


def clamp(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))


def overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.least(a2, b2) - F.greatest(a1, b1), F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """part / whole between 0 and 1; 0 where there is no whole."""
    return F.when(whole <= 0, 0.0).otherwise(clamp(F.try_divide(part, whole)))


def across(a: Box, b: Box) -> Column:
    """Horizontal overlap as a share of the narrower box."""
    return share(overlap(a.x1, a.x2, b.x1, b.x2), F.least(a.width, b.width))


def upright(a: Box, b: Box) -> Column:
    """Vertical overlap as a share of the lower box."""
    return share(overlap(a.y1, a.y2, b.y1, b.y2), F.least(a.height, b.height))


def blend(overlapping: Column, gap: Column, reach: Column, off: Column) -> Column:
    return 0.55 * overlapping + 0.30 * F.exp(-F.greatest(gap, F.lit(0.0)) / reach) + 0.15 * (1.0 - clamp(off))


def below(label: Box, value: Box) -> Column:
    """Score of a value under its label; null if it lies out of reach."""
    h, gap = F.greatest(label.height, F.lit(1.0)), value.y1 - label.y2
    near = gap.between(-0.35 * h, 3.0 * h) & (across(label, value) > 0.15)
    return F.when(near, blend(across(label, value), gap, 1.5 * h, F.abs(value.x1 - label.x1) / (4.0 * h)))


def right_of(label: Box, value: Box) -> Column:
    """Score of a value beside its label; null if it lies out of reach."""
    h, gap = F.greatest(label.height, F.lit(1.0)), value.x1 - label.x2
    near = gap.between(-0.2 * h, 10.0 * h) & (upright(label, value) > 0.35)
    return F.when(near, 0.92 * blend(upright(label, value), gap, 4.0 * h, F.abs(value.middle - label.middle) / h))


def extent(polygon: Column) -> Column:
    """Box around a polygon's points; null without two coordinates a point."""
    xs, ys = F.transform(polygon, lambda p: F.get(p, F.lit(0))), F.transform(polygon, lambda p: F.get(p, F.lit(1)))
    fits = (F.size(polygon) > 0) & F.forall(polygon, lambda p: F.size(p) >= 2)
    return F.when(fits, F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")))


def compress(geometry: Column) -> Column:
    return 0.75 + 0.25 * clamp(geometry)


def parser_confidence(strategy: Column, alike: Column, geometry: Column, form: Column, penalty: Column) -> Column:
    return clamp(strategy * clamp(alike) * compress(geometry) * clamp(form) * clamp(penalty))


def combined(ocr: Column, parser: Column) -> Column:
    return F.bround(clamp(ocr) * clamp(parser), 4)
