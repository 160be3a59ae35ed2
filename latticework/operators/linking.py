"""Lookups, updates and set operations by id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left without a partner; null keys have none."""
    return left.join(right.select(*on), on, "left_anti")


def fill_from(left: DataFrame, right: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Left rows with ``columns`` taken from right where right has them; keys of right must be unique."""
    r = right.select(*on, *[F.col(c).alias(f"_{c}") for c in columns])
    out = left.join(r, on, "left")
    return out.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in left.columns])


def require_unique(df: DataFrame, on: list[str]) -> None:
    """Raise if a key occurs twice; stops at the first such key."""
    twice = df.groupBy(*on).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{on} is not unique: {twice[0].asDict()}")


def in_priority(sources: list[DataFrame], on: list[str], columns: list[str]) -> DataFrame:
    """One row per key of any source; each column from the first source that has it."""
    parts = [s.select(*on, *[F.col(c).alias(f"{c}_{i}") for c in columns]) for i, s in enumerate(sources)]
    wide = reduce(lambda a, b: a.join(b, on, "full_outer"), parts)
    return wide.select(*on, *[F.coalesce(*[F.col(f"{c}_{i}") for i in range(len(sources))]).alias(c) for c in columns])


def changed(old: DataFrame, new: DataFrame, on: list[str], column: str) -> DataFrame:
    """(key, old, new) where the value differs, null being a value."""
    n = new.select(*on, F.col(column).alias("new"))
    both = old.select(*on, F.col(column).alias("old")).join(n, on)
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def overridden(base: Column, over: Column) -> Column:
    """A map with another's entries put over it; null maps are empty."""
    empty = F.create_map().cast("map<string,string>")
    b, o = F.coalesce(base, empty), F.coalesce(over, empty)
    return F.map_concat(F.map_filter(b, lambda k, v: ~F.map_contains_key(o, k)), o)
