"""Expressions over vectors held as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The dot product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no direction."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), length))


def finite(a: Column) -> Column:
    """Whether a vector has elements, all of them finite numbers; false for a null."""
    return F.coalesce((F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
