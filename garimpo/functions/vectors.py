"""Vector functions over arrays; elements are taken as doubles before they are multiplied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda m, v: m + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or zero, or lengths differ."""
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def checked(a: Column, dims: int) -> Column:
    """The vector; the query fails where it hasn't the configured length."""
    return F.when(F.size(a) == dims, a).otherwise(F.raise_error(F.concat(F.lit(f"vector has not {dims} dimensions but "), F.size(a).cast("string"))))
