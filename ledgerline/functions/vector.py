"""Vectors as arrays: products, norms and cosine in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0, null where the lengths differ, a vector or one of its components is null, or
    the score is not a finite number."""
    scale = norm(a) * norm(b)
    score = F.when(scale == 0, 0.0).when(scale < float("inf"), dot(a, b) / F.nullif(scale, F.lit(0.0)))
    return F.when((F.size(a) == F.size(b)) & (F.abs(score) < float("inf")), score)


def has_dimension(a: Column, n: int) -> Column:
    return F.size(a) == n
