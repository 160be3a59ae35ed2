"""How diversity and covered area grow with the steps of a loop."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators import diversity, hulls
from latticework.session import materialise


def cumulative(rows: DataFrame, steps: list[int], step: str = "step") -> DataFrame:
    """Each row once for every listed step from its own on."""
    at = F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s >= F.col(step))
    return rows.withColumn("upto", F.explode(at))


def growth(rows: DataFrame, ident: str, x: str, y: str, steps: list[int], size: int = 10_000, grid: float = 0.05, sigma: float | None = None, seed: int = 0, rounds: int = 4) -> DataFrame:
    """(upto, n, vendi, vendi_std, vendi_share, area, area_added, area_ratio) of all rows up to each step.

    Per step the Vendi score is the mean, with its deviation, over ``rounds`` seeded draws of ``size`` rows, or that of
    all rows if there are fewer; the area is that of the concave hull of the occupied cells of a grid. Both bound what
    reaches a task, whatever the number of rows.
    """
    if size > diversity.LIMIT:
        raise ValueError(f"at most {diversity.LIMIT} rows fit one task")
    cum = cumulative(materialise(rows.select(ident, "step", x, y), "growth"), steps)
    counts = cum.groupBy("upto").agg(F.count(F.lit(1)).alias("n"))
    each = cum.join(counts, "upto").withColumn("round", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > size, rounds - 1).otherwise(0))))
    key = F.md5(F.concat_ws(":", (F.col("round") + seed).cast("string"), F.col(ident).cast("string")))
    nth = F.row_number().over(Window.partitionBy("upto", "round").orderBy(key, ident))
    taken = materialise(each.withColumn("nth", nth).where(F.col("nth") <= size).select("upto", "round", x, y), "drawn")
    taken = taken.repartitionByRange(len(steps) * rounds, "upto", "round")  # stated: a draw is little data and much work

    def vendi(f: pd.DataFrame) -> pd.DataFrame:
        score = diversity.vendi_rbf(f[[x, y]].to_numpy(float), sigma)
        return pd.DataFrame({"upto": [f["upto"].iloc[0]], "score": [score]})

    cells = cum.select("upto", (F.round(F.col(x) / grid) * grid).alias("cx"), (F.round(F.col(y) / grid) * grid).alias("cy")).distinct()

    def area(f: pd.DataFrame) -> pd.DataFrame:
        pts = f[["cx", "cy"]].to_numpy(float)
        if len(pts) > hulls.LIMIT:
            raise ValueError("the grid is too fine for one task; widen it")
        ring, _ = hulls.concave_hull(pts)
        return pd.DataFrame({"upto": [f["upto"].iloc[0]], "area": [hulls.area(ring) if len(ring) > 2 else 0.0]})

    v = taken.groupBy("upto", "round").applyInPandas(vendi, "upto int, score double")
    v = v.groupBy("upto").agg(F.avg("score").alias("vendi"), F.stddev_pop("score").alias("vendi_std")).withColumn("vendi_share", F.col("vendi") / size)
    a = cells.groupBy("upto").applyInPandas(area, "upto int, area double")
    first = F.first("area").over(Window.orderBy("upto"))  # one row a step
    out = counts.join(v, "upto").join(a, "upto")
    return out.withColumn("area_added", F.col("area") - first).withColumn("area_ratio", F.when(first > 0, F.col("area") / first))
