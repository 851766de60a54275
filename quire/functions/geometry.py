"""Boxes as flat columns l, t, r, b: constructors, measures, relations, changes; all column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Four column expressions; minima first."""

    l: Column  # noqa: E741
    t: Column
    r: Column
    b: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        """The columns l, t, r, b with a prefix."""
        return cls(*(F.col(f"{prefix}{c}") for c in "ltrb"))

    @classmethod
    def from_ltwh(cls, left: Column, top: Column, width: Column, height: Column) -> Box:
        return cls(left, top, left + width, top + height)

    @property
    def width(self) -> Column:
        return self.r - self.l

    @property
    def height(self) -> Column:
        return self.b - self.t

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.l + self.r) / 2, (self.t + self.b) / 2

    def struct(self) -> Column:
        return F.struct(self.l.alias("l"), self.t.alias("t"), self.r.alias("r"), self.b.alias("b"))

    def columns(self, prefix: str = "") -> list[Column]:
        return [x.alias(f"{prefix}{c}") for c, x in zip("ltrb", (self.l, self.t, self.r, self.b), strict=True)]

    def ordered(self) -> Column:
        """Whether the minima are no larger than the maxima."""
        return (self.l <= self.r) & (self.t <= self.b)

    def usable(self) -> Column:
        """Whether all four coordinates are numbers."""
        return F.coalesce(~(F.isnan(self.l) | F.isnan(self.t) | F.isnan(self.r) | F.isnan(self.b)), F.lit(False)) & self.l.isNotNull() & self.t.isNotNull() & self.r.isNotNull() & self.b.isNotNull()

    def in_unit(self) -> Column:
        """Whether the box is in the unit square."""
        return self.ordered() & (self.l >= 0) & (self.t >= 0) & (self.r <= 1) & (self.b <= 1)

    def contains_point(self, x: Column, y: Column) -> Column:
        return x.between(self.l, self.r) & y.between(self.t, self.b)

    def contains(self, other: Box, slack: float = 0) -> Column:
        return (self.l - slack <= other.l) & (self.t - slack <= other.t) & (self.r + slack >= other.r) & (self.b + slack >= other.b)

    def intersects(self, other: Box) -> Column:
        """Closed edges: touching counts."""
        return (self.l <= other.r) & (other.l <= self.r) & (self.t <= other.b) & (other.t <= self.b)

    def overlap_x(self, other: Box) -> Column:
        return interval_overlap(self.l, self.r, other.l, other.r)

    def overlap_y(self, other: Box) -> Column:
        return interval_overlap(self.t, self.b, other.t, other.b)

    def horizontal_overlap_ratio(self, other: Box) -> Column:
        """Shared width over the smaller width; 0 if either has none."""
        smaller = F.least(self.width, other.width)
        return F.when(smaller > 0, self.overlap_x(other) / smaller).otherwise(F.lit(0.0))

    def intersection(self, other: Box) -> Box:
        """Null coordinates where nothing is shared."""
        some = (self.overlap_x(other) > 0) & (self.overlap_y(other) > 0)
        return Box(*(F.when(some, f(a, b)) for f, a, b in ((F.greatest, self.l, other.l), (F.greatest, self.t, other.t), (F.least, self.r, other.r), (F.least, self.b, other.b))))

    def union(self, other: Box) -> Box:
        return Box(F.least(self.l, other.l), F.least(self.t, other.t), F.greatest(self.r, other.r), F.greatest(self.b, other.b))

    def iou(self, other: Box) -> Column:
        """Intersection over union; 0 for boxes without area, equal ones too."""
        shared = self.overlap_x(other) * self.overlap_y(other)
        return F.when(shared > 0, shared / (self.area + other.area - shared)).otherwise(F.lit(0.0))

    def expand(self, dx: float | Column, dy: float | Column) -> Box:
        return Box(self.l - dx, self.t - dy, self.r + dx, self.b + dy)

    def clamp(self, width: Column, height: Column) -> Box:
        """Inside an image; null coordinates if nothing is left."""
        held = Box(F.greatest(self.l, F.lit(0.0)), F.greatest(self.t, F.lit(0.0)), F.least(self.r, width), F.least(self.b, height))
        left = (held.l < held.r) & (held.t < held.b)
        return Box(*(F.when(left, x) for x in (held.l, held.t, held.r, held.b)))

    def scale(self, width: Column, height: Column) -> Box:
        """Unit to whole pixels, ties to even."""
        return Box(F.bround(self.l * width), F.bround(self.t * height), F.bround(self.r * width), F.bround(self.b * height))

    def normalize(self, width: Column, height: Column) -> Box:
        return Box(self.l / width, self.t / height, self.r / width, self.b / height)

    def split_x(self, at: Column) -> tuple[Box, Box]:
        """Left and right of an absolute position."""
        return Box(self.l, self.t, at, self.b), Box(at, self.t, self.r, self.b)

    def pixels(self, width: Column, height: Column) -> Box:
        """Whole-pixel bounds inside an image."""
        return Box(F.greatest(F.floor(self.l), F.lit(0)), F.greatest(F.floor(self.t), F.lit(0)), F.least(F.ceil(self.r), width), F.least(F.ceil(self.b), height))

    def signature(self) -> Column:
        """A key of the box: coordinates to six places, ties to even."""
        return F.struct(*[F.bround(x, 6).alias(c) for c, x in zip("ltrb", (self.l, self.t, self.r, self.b), strict=True)])


def interval_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def interval_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Distance of two intervals, 0 if they meet."""
    return F.greatest(b0 - a1, a0 - b1, F.lit(0.0))


def union_boxes(prefix: str = "") -> list[Column]:
    """Aggregates for the union of boxes."""
    return [F.min(f"{prefix}l").alias("l"), F.min(f"{prefix}t").alias("t"), F.max(f"{prefix}r").alias("r"), F.max(f"{prefix}b").alias("b")]


def domain(largest: Column, extent: Column) -> Column:
    """The extent of a coordinate system: 1 if no coordinate is above 2."""
    return F.when(largest <= 2.0, F.lit(1.0)).otherwise(extent)


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x1 - x0, y1 - y0)
