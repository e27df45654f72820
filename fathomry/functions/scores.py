"""Vector scores as column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "inner_product")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column, metric: str) -> Column:
    if metric == "cosine":
        return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    if metric == "inner_product":
        return -dot(a, b)
    raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")


def similarity(d: Column, metric: str) -> Column:
    """A distance as a score: cosine clamped to 0..1, l2 to 0..1, inner product from 0."""
    if metric == "cosine":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d))
    if metric == "l2":
        return 1 / (1 + d)
    if metric == "inner_product":
        return F.greatest(F.lit(0.0), -d)
    raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
