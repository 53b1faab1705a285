"""Vector functions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


def degenerate(a: Column) -> Column:
    """Empty, non-finite, or of a norm of at most 1e-12."""
    return (F.size(a) <= 0) | F.exists(a, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) | (norm(a) <= TINY)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where either has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, finite(dot(a, b) / size)).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """Scaled to norm 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)
