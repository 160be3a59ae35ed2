"""Arithmetic on array columns, inside generated code; no Python."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, within [0, 2]; 1 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def tanimoto_distance(a: Column, b: Column) -> Column:
    """1 - (sum of products) / (sum of the larger squares)."""
    top = F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(x.cast("double") * x, y.cast("double") * y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(top == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / top)


def rbf(a: Column, b: Column, sigma: float) -> Column:
    d = euclidean(a, b)
    return F.exp(-d * d / (2 * sigma * sigma))


def outside(a: Column, low: Column, high: Column) -> Column:
    """Whether any component lies below its least or above its largest value."""
    return F.exists(F.zip_with(a, low, lambda x, y: x < y), lambda b: b) | F.exists(F.zip_with(a, high, lambda x, y: x > y), lambda b: b)


def by_position(df: DataFrame, vector: str, **aggs) -> DataFrame:
    """One array per aggregate: over all rows, position by position. Partial aggregates leave each map task as one row a position."""
    flat = df.select(F.posexplode(vector).alias("pos", "v"))
    each = flat.groupBy("pos").agg(*[f("v").alias(n) for n, f in aggs.items()])
    pick = lambda n: F.transform(F.array_sort(F.collect_list(F.struct("pos", n))), lambda s: s[n]).alias(n)
    return each.agg(*[pick(n) for n in aggs])


def circumradius(a: Column, b: Column, c: Column) -> Column:
    """Radius of the circle through a triangle's corners, from its side lengths."""
    s = (a + b + c) / 2
    area = F.sqrt(F.greatest(s * (s - a) * (s - b) * (s - c), F.lit(0.0)))
    return F.when(area > 0, a * b * c / (4 * area)).otherwise(F.lit(math.inf))
