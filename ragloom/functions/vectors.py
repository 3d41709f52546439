"""Vector functions on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """At unit length; a zero vector stays as it is."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length == 0, x.cast("double")).otherwise(x.cast("double") / length))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)
