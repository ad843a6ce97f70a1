"""Arithmetic, geometry and losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_away(x: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + F.lit(0.5))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def sigmoid2(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def circular_difference(a: Column, b: Column, n: int) -> Column:
    """a - b on a circle of n steps, from -n/2 to n/2."""
    d = a - b
    return F.when(d > n / 2, d - n).when(d < -n / 2, d + n).otherwise(d)


def rotate(x: Column, y: Column, angle: Column, scale: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """An affine map: turn by ``angle``, scale, then shift."""
    c, s = F.cos(angle), F.sin(angle)
    return scale * (c * x - s * y) + dx, scale * (s * x + c * y) + dy


def overlap_area(a: tuple, b: tuple) -> Column:
    """Shared area of two boxes (x, y, w, h); extents that do not meet count 0."""
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: tuple, b: tuple) -> Column:
    shared = overlap_area(a, b)
    union = a[2] * a[3] + b[2] * b[3] - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def taxonomic_loss(same_class: Column, same_genus: Column, same_family: Column, same_order: Column) -> Column:
    """0 for the same class, then 1 genus, 2 family, 3 order, 4 beyond."""
    return F.when(same_class, 0).when(same_genus, 1).when(same_family, 2).when(same_order, 3).otherwise(4)


def study_loss(taxonomic: Column, seconds: Column, seconds_a_level: float = 45.0, most: float = 5.0) -> Column:
    return F.least(F.lit(most), taxonomic + seconds / F.lit(seconds_a_level))
