"""Vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null when a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.nullif(norm, F.lit(0.0))


def normalised(a: Column) -> Column:
    """The vector at length 1 in double precision; null for null and zero vectors and ones with null components."""
    norm = F.nullif(F.sqrt(dot(a, a)), F.lit(0.0))
    return F.when(norm.isNotNull(), F.transform(a, lambda x: x.cast("double") / norm))
