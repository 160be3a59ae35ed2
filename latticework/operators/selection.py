"""Top rows, evenly spread rows, seeded samples, quotas and splits. Order comes from columns, never from partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *ids: Column | str) -> Column:
    """A reproducible random key: the md5 of the seed and the ids."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in ids]))


def lowest(df: DataFrame, value: str, n: int, *ties: str) -> DataFrame:
    """The n rows of least value, nulls last (a distributed top-n, no full sort)."""
    return df.orderBy(F.asc_nulls_last(value), *ties).limit(n)


def sample(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """n rows at random, without replacement, the same for the same seed."""
    return df.orderBy(draw(seed, *ids), *ids).limit(n)


def seed_size(n: Column | int, share: float, least: int, most: int) -> Column:
    """A share of n, at least ``least``, at most ``most`` and n, and at least one."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.greatest(F.least(F.greatest((n * share).cast("long"), F.lit(least)), F.lit(most), n), F.lit(1))


def evenly(df: DataFrame, by: list[str], pos: str, n_key: str, m: Column) -> DataFrame:
    """Of each group's n rows (``pos`` from 0, ``n_key`` their number) the m at whole parts of an even spacing from first to last."""
    m = F.greatest(m.cast("int"), F.lit(1))
    ats = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.when(m == 1, F.lit(0)).otherwise(F.floor(i * (F.col(n_key) - 1) / (m - 1))).cast("int"))
    return df.where(F.array_contains(ats, F.col(pos).cast("int")))


def stride(df: DataFrame, pos: str, n: str, share: float) -> DataFrame:
    """Every int(n * share)-th row; if that is zero, every (n // 2)-th."""
    step = F.greatest(F.when((F.col(n) * share).cast("int") > 0, (F.col(n) * share).cast("int")).otherwise((F.col(n) / 2).cast("int")), F.lit(1))
    return df.where(F.col(pos) % step == 0)


def capped(df: DataFrame, pos: str, n: str, limit: int) -> DataFrame:
    """At most ``limit`` rows: those at int(i * n / limit)."""
    i = F.ceil(F.col(pos) * limit / F.col(n))
    return df.where((F.col(n) <= limit) | ((i < limit) & (F.floor(i * F.col(n) / limit) == F.col(pos))))


def cap_per_group(df: DataFrame, by: list[str], limit: int, keep: str, seed: int, *ids: str) -> DataFrame:
    """Per group all rows with ``keep`` and, of the others, as many at random as the limit leaves."""
    w = Window.partitionBy(*by).orderBy(F.desc(keep), draw(seed, *ids), *ids)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col(keep) | (F.col("_n") <= limit)).drop("_n")


def by_size(df: DataFrame, size: str, n: int, seed: int, *ids: str) -> DataFrame:
    """A sample spread over sizes: equal-width bins with equal quotas, the first bins get the rest, and what is missing is topped up at random."""
    shape = df.agg(F.min(size).alias("lo"), F.max(size).alias("hi"), F.countDistinct(size).alias("k"))
    bins = F.least(F.col("k"), F.lit(max(1, n // 5)))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(bins - 1, F.floor((F.col(size) - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))))
    binned = df.join(F.broadcast(shape)).withColumn("_b", b.cast("int")).withColumn("_k", bins)
    nth = F.row_number().over(Window.partitionBy("_b").orderBy(draw(seed, *ids), *ids))
    quota = F.floor(F.lit(n) / F.col("_k")) + (F.col("_b") < F.lit(n) % F.col("_k")).cast("int")
    ranked = binned.withColumn("_late", (nth > quota).cast("int"))
    return ranked.orderBy("_late", draw(seed, *ids), *ids).limit(n).drop("_late", "_b", "_k", "lo", "hi", "k")


def split(df: DataFrame, parts: dict[str, float], seed: int, *ids: str) -> DataFrame:
    """``part``: by the hash of the ids, so a row's part does not depend on the other rows, and nothing is shuffled."""
    u = F.conv(F.substring(draw(seed, *ids), 1, 8), 16, 10).cast("double") / float(1 << 32)
    at, chain = 0.0, None
    for name, share in parts.items():
        at += share
        chain = F.when(u < at, name) if chain is None else chain.when(u < at, name)
    return df.withColumn("part", chain.otherwise(list(parts)[-1]))


def chunks(df: DataFrame, k: int, by: list[str], *order: str) -> DataFrame:
    """``chunk``: k near-equal runs of each group, the first ones longer by one."""
    return df.withColumn("chunk", F.ntile(k).over(Window.partitionBy(*by).orderBy(*order)))
