"""Vector expressions on array columns; arithmetic is in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(v: Column, floor: float = 1e-9) -> Column:
    """Divide by the norm; a zero vector is divided by ``floor``."""
    n = norm(v)
    return F.transform(v, lambda x: x / F.when(n == 0, F.lit(floor)).otherwise(n))
