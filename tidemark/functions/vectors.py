"""Vector arithmetic on array columns; products are summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where the widths differ."""
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where the widths differ or one vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def normalised(a: Column) -> Column:
    """The vector at unit length; the zero vector becomes the first unit vector."""
    n = norm(a)
    first = F.transform(a, lambda x, i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float"))
    return F.when(n > 0, F.transform(a, lambda x: (x.cast("double") / n).cast("float"))).otherwise(first)
