"""Joins by distance in the plane and in descriptor space.

Radius joins put points on a grid of the radius's width, so that each point meets the 3 x 3 cells
about it by an equi-join; nothing is compared with everything. Targets are a small stated set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.vector import euclidean

MOST_TARGETS = 1_000


def neighbourhood(targets: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """For each target (tid, tx, ty): number of points (x, y) within the radius and the least distance among them (null: none)."""
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    cell = lambda c: F.floor(F.col(c) / radius)
    t = targets.select("tid", "tx", "ty", F.explode(near).alias("dx"), cell("tx").alias("cx"), cell("ty").alias("cy")).select("*", F.explode(near).alias("dy"))
    t = t.select("tid", "tx", "ty", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    p = points.select("x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    dist = F.sqrt((F.col("tx") - F.col("x")) * (F.col("tx") - F.col("x")) + (F.col("ty") - F.col("y")) * (F.col("ty") - F.col("y")))
    hits = t.join(p, ["cx", "cy"]).withColumn("dist", dist).where(F.col("dist") <= radius)
    found = hits.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("nearest"))
    return targets.select("tid").join(found, "tid", "left").select("tid", F.coalesce("n", F.lit(0)).alias("n"), "nearest")


def nearest_to(targets: DataFrame, rows: DataFrame, vector: str, k: int, *ids: str) -> DataFrame:
    """The k rows nearest to each of a small stated set of targets (tid, target). Each map task keeps k per target before the shuffle.

    The targets are read behind a check of their number and become literals of the plan: nothing is joined.
    """
    given = targets.select("tid", F.col("target").cast("array<double>").alias("target")).limit(MOST_TARGETS + 1).collect()
    if len(given) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    if not given:
        return rows.where(F.lit(False)).select("*", F.lit(None).cast(targets.schema["tid"].dataType).alias("tid"), F.lit(0.0).alias("dist"), F.lit(0).alias("rank"))
    each = F.array(*[F.struct(F.lit(t["tid"]).cast(targets.schema["tid"].dataType).alias("tid"), F.array(*[F.lit(float(v)) for v in t["target"]]).alias("target")) for t in given])
    d = rows.select("*", F.inline(each)).withColumn("dist", euclidean(F.col(vector), F.col("target")))
    w = Window.partitionBy("tid").orderBy("dist", *ids)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("target")


def nearest_within(centres: DataFrame, points: DataFrame, centre: str, key: str, radius: float) -> DataFrame:
    """(centre, key, dist): the nearest point of each view centre within a radius; none where there is none.

    Both sides meet in cells of the radius, a centre in the nine about it; ties go to the smaller key. Distances to nine places.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    ask = centres.withColumn("_di", F.explode(near)).withColumn("_dj", F.explode(near)).select(centre, "tx", "ty", (cell("tx") + F.col("_di")).alias("_i"), (cell("ty") + F.col("_dj")).alias("_j"))
    both = ask.join(points.select(key, "x", "y", cell("x").alias("_i"), cell("y").alias("_j")), ["_i", "_j"])
    d = F.round(F.sqrt((F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty"))), 9)
    best = both.withColumn("dist", d).where(F.col("dist") <= radius).groupBy(centre).agg(F.min(F.struct("dist", key)).alias("b"))
    return best.select(centre, f"b.{key}", "b.dist")
