"""Functions of array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """1 for two zero vectors, null if one is zero, else within -1 and 1."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), na * nb))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def average(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2)


def fuse(*blocks: Column) -> Column:
    return F.concat(*blocks)


def two_dimensions(a: Column) -> Column:
    """The first two coordinates, 0 where there are fewer."""
    return F.slice(F.concat(a.cast("array<double>"), F.array(F.lit(0.0), F.lit(0.0))), 1, 2)
