"""Scores of feature vectors: arrays of equal order, or sums over sparse features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Active dimensions from which a comparison has full support.
FULL_DIMENSIONS = 8.0


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def magnitude(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(dot_: Column, mag_a: Column, mag_b: Column) -> Column:
    """0 where a magnitude is 0."""
    return F.when((mag_a == 0) | (mag_b == 0), F.lit(0.0)).otherwise(dot_ / (mag_a * mag_b))


def confidence(shared: Column, active: Column, total_a: Column, total_b: Column) -> Column:
    """Mean of overlap (shared of active dimensions), balance (smaller of larger total) and support (active of 8)."""
    some = (active > 0) & (total_a != 0) & (total_b != 0)
    overlap = shared.cast("double") / active
    balance = F.least(total_a, total_b).cast("double") / F.greatest(total_a, total_b)
    support = F.least(F.lit(1.0), active / F.lit(FULL_DIMENSIONS))
    return F.when(some, (overlap + balance + support) / 3).otherwise(F.lit(0.0))


def array_confidence(a: Column, b: Column) -> Column:
    """Confidence of two arrays: a dimension is active if either side is not 0, shared if both are."""
    pair = F.arrays_zip(a.alias("a"), b.alias("b"))
    n = lambda test: F.size(F.filter(pair, test))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + F.abs(y.cast("double")))
    return confidence(n(lambda x: (x["a"] != 0) & (x["b"] != 0)), n(lambda x: (x["a"] != 0) | (x["b"] != 0)), total(a), total(b))
