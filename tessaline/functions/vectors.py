"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def unit(a: Column) -> Column:
    """`a` over its norm; as it is if the norm is 1e-9 or less."""
    size = norm(a)
    return F.when(size > 1e-9, F.transform(a, lambda x: x / size)).otherwise(a)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")
