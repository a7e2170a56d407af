"""Vector expressions on ``array<float>`` columns; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(v: Column) -> Column:
    """Unit vector in double; null for a zero vector."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector is zero or the sizes differ."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale)


def not_empty(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0)
