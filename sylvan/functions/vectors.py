"""Vector expressions over arrays, evaluated in the JVM in array order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def finite(a: Column) -> Column:
    """Whether every element is a finite number (as float32)."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, kept within [0, 2]; 1 where a norm is zero. Null where a vector is null or not
    finite, or where the dimensions differ."""
    n = norm(a) * norm(b)
    sim = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & finite(a) & finite(b), 1.0 - sim)
