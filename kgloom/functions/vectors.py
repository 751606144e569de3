"""Vectors as array columns; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """A vector of length one; ``EPSILON`` keeps null vectors finite."""
    size = norm(a) + F.lit(EPSILON)
    return F.transform(a, lambda x: x.cast("double") / size)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(EPSILON)) * (norm(b) + F.lit(EPSILON)))


def mean_of(vectors: Column, size: int) -> Column:
    """The mean of a column of vectors as an aggregate over a fixed number of coordinates, merged map-side."""
    return F.array(*[F.avg(F.get(vectors, i).cast("double")) for i in range(size)])
