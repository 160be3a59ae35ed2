"""Repeated structures by similarity of averaged descriptors.

``any_earlier``: a row is a repeat if some earlier row of its group is at least as similar as the
threshold. Exact: unit vectors whose cosine is at least t are at most sqrt(2 - 2t) apart, and so are their
projections on fixed directions; rows meet only in cells of these projections. Equal vectors are one class before
that, and cells that hold many classes are cut into blocks on both sides, all of which meet.

``greedy``: in order, a row is a repeat if it is similar to a row kept before it. One task per group, which
must hold at most LIMIT rows after exact copies are folded; larger groups are refused, not cut.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.vector import dot, norm
from latticework.session import materialise

LIMIT = 20_000
AXES = 3


def _axes(dim: int) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(dim, AXES)))
    return q.T


#: Classes of one side that meet in one block.
BLOCK = 2_048
#: Rows that one call compares, of several cells.
BUCKET = 8_000


def any_earlier(df: DataFrame, group: list[str], order: str, vector: str, dim: int, threshold: float = 0.999) -> DataFrame:
    """(order, first): the repeats and the earliest row each repeats. ``order`` must be unique."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    width = 2 * reach
    kind = dict(df.dtypes)[order]
    size = norm(F.col(vector))
    unit = df.select(*group, order, F.transform(vector, lambda x: F.try_divide(x.cast("double"), size)).alias("_u")).where(F.size("_u") == dim).where(~F.exists("_u", lambda x: x.isNull() | F.isnan(x)))
    # equal vectors are one class; its earliest row stands for it
    classes = materialise(unit.groupBy(*group, "_u").agg(F.min(order).alias("_m")), "classes")
    axes = [dot(F.col("_u"), F.array(*[F.lit(float(w)) for w in axis])) for axis in _axes(dim)]
    held = classes.select(*group, "_m", "_u", *[p.alias(f"_p{i}") for i, p in enumerate(axes)])
    cells = [f"_c{i}" for i in range(AXES)]
    base = held.select(F.xxhash64(*group, *[F.floor(F.col(f"_p{i}") / width) for i in range(AXES)]).alias("_cell"), F.lit(False).alias("_ask"), "_m", "_u", *group)
    ask = held
    for i, c in enumerate(cells):
        ask = ask.withColumn(c, F.explode(F.array_distinct(F.array(F.floor((F.col(f"_p{i}") - reach) / width), F.floor((F.col(f"_p{i}") + reach) / width)))))
    ask = ask.select(F.xxhash64(*group, *cells).alias("_cell"), F.lit(True).alias("_ask"), "_m", "_u", *group)
    both = base.unionByName(ask)
    counts = both.groupBy("_cell").agg(F.count_if(~F.col("_ask")).alias("n"), F.count_if("_ask").alias("m")).where("n > 0 and m > 0")
    counts = counts.select("_cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("_nb"), F.ceil(F.col("m") / BLOCK).cast("int").alias("_mb"))
    own = F.expr("pmod(hash(_m), if(_ask, _mb, _nb))")
    parts = F.expr("if(_ask, transform(sequence(0, _nb - 1), i -> i * _mb + _own), transform(sequence(0, _mb - 1), j -> _own * _mb + j))")
    blocks = both.join(counts, "_cell").withColumn("_own", own).withColumn("_part", F.explode(parts))
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), classes.count() * 2 // BUCKET)
    blocks = blocks.withColumn("_bucket", F.pmod(F.xxhash64("_cell", "_part"), F.lit(buckets))).drop("_own", "_nb", "_mb")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in f.groupby(["_cell", "_part", *group], sort=False, dropna=False):
            side = g["_ask"].to_numpy(bool)
            a, b = g[~side].sort_values("_m"), g[side]
            if not len(a) or not len(b):
                continue
            x, y, first = np.array(a["_u"].tolist()), np.array(b["_u"].tolist()), a["_m"].to_numpy()
            for s in range(0, len(b), 512):
                close = y[s : s + 512] @ x.T >= threshold
                hit = close.any(1)
                out.append(pd.DataFrame({"_m": b["_m"].to_numpy()[s : s + 512][hit], "first": first[close.argmax(1)[hit]]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"_m": [], "first": []})

    near = blocks.repartition(buckets, "_bucket").groupBy("_bucket").applyInPandas(run, f"_m {kind}, first {kind}").groupBy("_m").agg(F.min("first").alias("first"))
    best = classes.join(near, "_m", "left").select(*group, "_u", F.least("_m", F.coalesce("first", "_m")).alias("first"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, "_u")]
    return unit.alias("r").join(best.alias("b"), reduce(lambda p, q: p & q, same)).where(F.col("first") < F.col(order)).select(order, "first")


def greedy(df: DataFrame, group: list[str], order: str, vector: str, threshold: float = 0.999) -> DataFrame:
    """(order, repeat_of): every row with the kept row it repeats, null for kept rows."""
    kind = dict(df.dtypes)[order]
    size = df.groupBy(*group).count().where(F.col("count") > LIMIT).limit(1).collect()
    if size:
        raise ValueError(f"group {size[0].asDict()} holds more than {LIMIT} rows; use any_earlier")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order)
        x = np.array(f[vector].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        ids, kept, of = f[order].to_numpy(), [], []
        for i in range(len(x)):
            s = x[kept] @ x[i] if kept else np.zeros(0)
            j = int(np.argmax(s)) if len(s) else -1
            if j >= 0 and s[j] >= threshold:
                of.append(ids[kept[j]])
            else:
                of.append(None)
                kept.append(i)
        return pd.DataFrame({order: ids, "repeat_of": pd.array(of, dtype="object")})

    return df.where(F.col(vector).isNotNull()).select(*group, order, vector).groupBy(*group).applyInPandas(run, f"{order} {kind}, repeat_of {kind}")
