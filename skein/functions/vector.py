"""Vector functions over arrays; sums run in double precision in the order of the components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return _sum(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    size = norm(F.slice(a, 1, n)) * norm(F.slice(b, 1, n))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def unit(a: Column) -> Column:
    size = norm(a)
    return F.when(size == 0, a).otherwise(F.transform(a, lambda x: x / size))
