"""Vector functions over ``ARRAY<DOUBLE>`` columns, and score normalisation over windows."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero norms."""
    whole = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(whole, dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def squared_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v)


def min_max(c: Column, w: WindowSpec) -> Column:
    """1 where all are equal."""
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi == lo, 1.0).otherwise((c - lo) / (hi - lo))


def share_of_max(c: Column, w: WindowSpec) -> Column:
    """Positive finite scores by the largest; null for others."""
    good = F.when((c > 0) & (c < float("inf")), c)
    return good / F.max(good).over(w)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), c))))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def quantised(a: Column) -> tuple[Column, Column, Column]:
    """(codes of 8 bits, minimum, step)."""
    lo, hi = F.array_min(a), F.array_max(a)
    step = F.when(hi > lo, (hi - lo) / 255).otherwise(1.0)
    return F.transform(a, lambda x: F.floor((x - lo) / step + 0.5).cast("int")), lo, step


def dequantised(codes: Column, lo: Column, step: Column) -> Column:
    return F.transform(codes, lambda x: lo + x * step)
