"""Column expressions over arrays of numbers. Arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import RATIONAL


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v over its length, a zero vector staying zero."""
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / n)


def chord(cosine: Column) -> Column:
    return F.sqrt(F.greatest(2 - 2 * cosine, F.lit(0.0)))


def normal_cdf(x: Column) -> Column:
    """The normal distribution function by numeric.RATIONAL."""
    size = F.abs(x) / F.sqrt(F.lit(2.0))
    at = 1 / (1 + RATIONAL[0] * size)
    tail = F.lit(0.0)
    for c in RATIONAL[1]:
        tail = tail * at + c
    return 0.5 * (1 + F.signum(x) * (1 - tail * F.exp(-size * size)))


def confusion(cosine: Column, sigma) -> Column:
    """The chance that noise of width sigma swaps two unit vectors."""
    return normal_cdf(-chord(cosine) / (2.0 * sigma))


def truncate(v: Column, dims: int) -> Column:
    """The first dims components, at unit length again."""
    return unit(F.slice(v, 1, dims))
