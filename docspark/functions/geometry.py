"""Boxes: struct(left, top, width, height) of integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(left: Column, top: Column, width: Column, height: Column) -> Column:
    return F.struct(left.cast("int").alias("left"), top.cast("int").alias("top"), width.cast("int").alias("width"), height.cast("int").alias("height"))


def from_points(xs: Column, ys: Column) -> Column:
    """Around the points of a quadrilateral, or between two corners; at least one wide and high."""
    return box(F.array_min(xs), F.array_min(ys), F.greatest(F.array_max(xs) - F.array_min(xs), F.lit(1)), F.greatest(F.array_max(ys) - F.array_min(ys), F.lit(1)))


def right(b: Column) -> Column:
    return b["left"] + b["width"]


def bottom(b: Column) -> Column:
    return b["top"] + b["height"]


def union_of(b: Column) -> Column:
    """Aggregate: the box around all boxes of a group."""
    left, top = F.min(b["left"]), F.min(b["top"])
    return box(left, top, F.max(right(b)) - left, F.max(bottom(b)) - top)


def overlap_area(a: Column, b: Column) -> Column:
    zero = F.lit(0)
    return F.greatest(zero, F.least(right(a), right(b)) - F.greatest(a["left"], b["left"])) * F.greatest(zero, F.least(bottom(a), bottom(b)) - F.greatest(a["top"], b["top"]))


def x_overlaps(a: Column, b: Column, share: float = 0.3) -> Column:
    """The overlap in x exceeds a share of the narrower width."""
    return F.least(right(a), right(b)) - F.greatest(a["left"], b["left"]) > share * F.least(a["width"], b["width"])


def grow(b: Column, pad: int, width: Column, height: Column) -> Column:
    """Padded on all sides, within the page."""
    left, top = F.greatest(b["left"] - pad, F.lit(0)), F.greatest(b["top"] - pad, F.lit(0))
    return box(left, top, F.least(right(b) + pad, width) - left, F.least(bottom(b) + pad, height) - top)


def centre_inside(inner: Column, outer: Column) -> Column:
    x, y = inner["left"] + inner["width"] / 2, inner["top"] + inner["height"] / 2
    return (x >= outer["left"]) & (x <= right(outer)) & (y >= outer["top"]) & (y <= bottom(outer))


def luminance(red: Column, green: Column, blue: Column) -> Column:
    return 0.299 * red + 0.587 * green + 0.114 * blue


def ink(red: Column, green: Column, blue: Column) -> Column:
    """Black on light ground, white on dark."""
    return F.when(luminance(red, green, blue) > 127, "black").otherwise("white")
