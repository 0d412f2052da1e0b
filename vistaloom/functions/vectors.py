"""Expressions over array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column | str) -> Column:
    """Unit length; a zero vector stays."""
    a = F.col(a) if isinstance(a, str) else a
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def angular_similarity(cosine: Column) -> Column:
    """max(0, 1 - d*d / 2), where d is the distance of unit vectors: the cosine, cut at 0."""
    return F.greatest(F.lit(0.0), 1 - (2 - 2 * cosine) / 2)


def verdict(similarity: Column) -> Column:
    return F.when(similarity > 0.5, "high").when(similarity > 0.35, "likely").otherwise("different")
