"""Column functions on dense vectors; arithmetic is in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """[X14]"""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """[X13] scaled to length 1; a zero vector gives NaN."""
    return bind(as_double(v), lambda d: bind(norm(d), lambda n: F.transform(d, lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(F.try_divide(x, n)))))


def clip(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def angular(similarity: Column) -> Column:
    """[X16] acos / pi of a dot product of unit vectors."""
    return F.acos(clip(similarity)) / math.pi


def first_coordinate(v: Column, direction: list[float]) -> Column:
    """[X20] projection on one direction."""
    return dot(v, F.array(*[F.lit(float(x)) for x in direction]))
