"""Column functions on array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column, eps: float = 0.0) -> Column:
    """The vector and its norm are values to the function of an element, or both would be worked out again for each of them."""
    scaled = lambda v: F.get(F.transform(F.array(norm(v) + F.lit(eps)), lambda n: F.transform(v, lambda x: x / n)), F.lit(0))
    return F.get(F.transform(F.array(a), scaled), F.lit(0))


def l1_normalize(a: Column, eps: float = 1e-8) -> Column:
    n = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x)) + F.lit(eps)
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-8))


def euclid(a: Column, b: Column) -> Column:
    """Distance by the expansion |a|^2 + |b|^2 - 2ab, with rounding below zero clamped."""
    return F.sqrt(F.greatest(dot(a, a) + dot(b, b) - 2 * dot(a, b), F.lit(0.0)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def blend(a: Column, b: Column, alpha: float) -> Column:
    return F.zip_with(a, b, lambda x, y: alpha * x + (1 - alpha) * y)
