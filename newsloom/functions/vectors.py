"""Vector expressions on ``array<double>`` or ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity, 0 when either vector has no length.

    Pass stored norms to skip two of the three sums.
    """
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.coalesce(F.try_divide(dot(a, b), length), F.lit(0.0))


def unit_interval(similarity: Column) -> Column:
    """Map a cosine from [-1, 1] to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity + 1.0) / 2.0))
