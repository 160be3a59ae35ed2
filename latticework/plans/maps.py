"""A map of descriptors in the plane: two principal axes in the place of a trained encoder, points, boundary, growth by step.

The axes come from the second moments of all rows, which one aggregation gives whatever their number; only d x d numbers
reach the driver. A trained encoder's weights go through ``builders.encode`` instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators import hulls


@dataclass
class Axes:
    """Mean, the first axes (rows) and the share of the variance they carry."""

    mean: np.ndarray
    axes: np.ndarray
    share: float


def fit(df: DataFrame, vector: str, dim: int, n: int = 2) -> Axes:
    """Principal axes; rows of another length or with numbers that are not finite take no part. Signs: the largest entry is positive."""

    def moments(frames):
        total = np.zeros((dim + 1, dim + 1))
        for f in frames:
            x = np.array([v for v in f[vector] if v is not None and len(v) == dim and all(e is not None for e in v)], float).reshape(-1, dim)
            x = x[np.isfinite(x).all(1)]
            x = np.column_stack([x, np.ones(len(x))])
            total += x.T @ x
        yield pd.DataFrame({"pos": range((dim + 1) ** 2), "v": total.ravel()})

    flat = np.zeros((dim + 1) ** 2)
    for r in df.select(vector).mapInPandas(moments, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect():
        flat[r["pos"]] = r["v"]
    m = flat.reshape(dim + 1, dim + 1)
    count = m[-1, -1]
    if not count:
        return Axes(np.zeros(dim), np.eye(n, dim), 0.0)
    mean = m[-1, :-1] / count
    values, vectors = np.linalg.eigh(m[:-1, :-1] / count - np.outer(mean, mean))
    axes = vectors[:, ::-1][:, :n].T
    axes = axes * np.sign(axes[np.arange(n), np.abs(axes).argmax(1)])[:, None]
    total = float(values.sum())
    return Axes(mean, axes, float(values[::-1][:n].sum() / total) if total > 0 else 1.0)


def placed(vector: str, a: Axes) -> list[Column]:
    """The coordinates of a row on the axes, as built-in expressions."""
    out = []
    for axis in a.axes:
        w = F.array(*[F.lit(float(x)) for x in axis])
        dot = F.aggregate(F.zip_with(F.transform(vector, lambda x: x.cast("double")), w, lambda x, y: x * y), F.lit(0.0), lambda p, q: p + q)
        out.append(dot - float(axis @ a.mean))
    return out


def build(df: DataFrame, vector: str, dim: int, **hull) -> tuple[DataFrame, Axes, list]:
    """(rows with x and y, axes, boundary)."""
    a = fit(df, vector, dim)
    x, y = placed(vector, a)
    rows = df.withColumn("x", x).withColumn("y", y)
    got = hulls.extremes(rows, "x", "y").orderBy("x", "y").collect()  # at most hulls.LIMIT
    ring, _ = hulls.concave_hull(np.array([(r["x"], r["y"]) for r in got]).reshape(-1, 2), distance=hulls.mean_nearest(rows, "x", "y"), weights=np.array([float(r["n"]) for r in got]), **hull)
    return rows, a, ring


def evolution(rows: DataFrame, step: str, ring: list) -> DataFrame:
    """(step, n, outside): how many points each step adds, and how many of them lie outside a boundary."""
    from latticework.functions.geometry import inside

    out = ~inside(F.col("x"), F.col("y"), ring) if len(ring) > 2 else F.lit(True)
    return rows.groupBy(step).agg(F.count(F.lit(1)).alias("n"), F.count_if(out).alias("outside"))
