"""Decisions on predictions of a committee of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(predictions: DataFrame, by: list[str], value: str, sample: bool = True) -> DataFrame:
    """Standard deviation over the models of each group: null values are skipped, fewer than two models give zero."""
    f = F.stddev_samp if sample else F.stddev_pop
    return predictions.groupBy(*by).agg(F.coalesce(f(value), F.lit(0.0)).alias("spread"), F.count(value).alias("n_models"))


def flag_training(s: Column, rmse: float, target: float, factor: float, upper: float = 10.0) -> Column:
    """Uncertain, but not so much as to be an outlier: theta <= s < upper * theta with theta = max(factor * rmse, target)."""
    theta = max(factor * rmse, target)
    return (s >= theta) & (s < upper * theta)


def flag_threshold(df: DataFrame, value: str, low: float = 3.0, high: float = 10.0, sample: bool = True) -> DataFrame:
    """``flag``: mean + low * std <= value < mean + high * std over all rows; the one-row statistics are broadcast."""
    f = F.stddev_samp if sample else F.stddev_pop
    stats = df.agg(F.avg(value).alias("_m"), F.coalesce(f(value), F.lit(0.0)).alias("_s"))
    flag = (F.col(value) >= F.col("_m") + low * F.col("_s")) & (F.col(value) < F.col("_m") + high * F.col("_s"))
    return df.join(F.broadcast(stats)).withColumn("flag", flag).drop("_m", "_s")


def flag_confidence(df: DataFrame, value: str, k: float = 3.0) -> DataFrame:
    """``flag``: value at least k standard deviations (population) above the mean of all rows."""
    stats = df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(F.broadcast(stats)).withColumn("flag", F.col(value) >= F.col("_m") + k * F.col("_s")).drop("_m", "_s")


def best_model(results: DataFrame, energy: str, force: str, weight: float = 0.1, *ties: str) -> DataFrame:
    """``best``: the row of least energy error plus weighted force error; rows without both are failed and never best."""
    score = F.col(energy) + weight * F.col(force)
    top = results.where(score.isNotNull()).select(F.struct(score, *ties).alias("k")).agg(F.min("k").alias("k"))
    return results.join(F.broadcast(top)).withColumn("best", F.coalesce(F.struct(score, *ties) == F.col("k"), F.lit(False))).drop("k")


def iqr_mask(df: DataFrame, value: str, by: list[str] | None = None, low: float = 0.3, high: float = 0.7, reach: float = 1.5, accuracy: int | None = None) -> DataFrame:
    """``kept``: the value within the fences of the 30 % and 70 % points, else null.

    The points are exact, for which a group's distinct values must fit one task; with ``accuracy`` they are off by at most n / accuracy ranks, for any group.
    """
    shares = F.array(F.lit(low), F.lit(high))
    points = F.percentile(value, shares) if accuracy is None else F.percentile_approx(value, shares, accuracy)
    q = df.groupBy(*(by or [])).agg(points.alias("_q"))
    joined = df.join(q, by) if by else df.join(F.broadcast(q))  # one row
    a, b = F.col("_q")[0], F.col("_q")[1]
    inside = (F.col(value) >= a - reach * (b - a)) & (F.col(value) <= b + reach * (b - a))
    return joined.withColumn("kept", F.when(inside, F.col(value))).drop("_q")


def error_metrics(df: DataFrame, pairs: dict[str, tuple[Column, Column]], by: list[str] | None = None) -> DataFrame:
    """mae_<n> and rmse_<n> of each pair of columns, in one pass."""
    aggs = []
    for n, (a, b) in pairs.items():
        aggs += [F.avg(F.abs(a - b)).alias(f"mae_{n}"), F.sqrt(F.avg((a - b) * (a - b))).alias(f"rmse_{n}")]
    return df.groupBy(*(by or [])).agg(*aggs)


def within_limits(d_energy: Column, d_force: Column, energy: float, force: float) -> Column:
    """Both differences below their limits, or one of them missing."""
    return d_energy.isNull() | d_force.isNull() | ((F.abs(d_energy) < energy) & (F.abs(d_force) < force))
