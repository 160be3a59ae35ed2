"""Statistics out of a loop's log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The lines that loops write.
START = r"Starting AL Loop iteration (\d+)/(\d+)\.\.\."
SIZES = r"Iteration (\d+): seed_gen_db (\d+), training_db: (\d+) entries"
BEST = r"Best model of current step.*RMSE E: ([\d.]+) meV/at, RMSE F: ([\d.]+) meV/"
DOMAIN = r"Extrapolation statistics \(AL step (\d+)\): (\d+) interpolating.*?, (\d+) extrapolating.*?, (\d+) out-of-domain \(union\), (\d+) in-domain, (\d+) after filters / (\d+) total frames"
SUBMITTED = r"Submitted to DFT: (\d+)"
PK = r"(?:[Ss]ubmitted .*?<(\d+)>|PK[:= ]+(\d+))"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def _n(pattern: str, group: int, kind: str = "long") -> Column:
    return F.nullif(F.regexp_extract("line", pattern, group), F.lit("")).cast(kind)


def submitted_pk(line: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(line, PK, 1), F.lit("")), F.nullif(F.regexp_extract(line, PK, 2), F.lit(""))).cast("long")


def iterations(lines: DataFrame, by: list[str]) -> DataFrame:
    """One row per log (``by``) and started iteration. The i-th best-model line belongs to the i-th start."""
    start = lines.withColumn("step", _n(START, 1)).where("step is not null")
    w = Window.partitionBy(*by).orderBy("pos")
    started = start.select(*by, "step", _n(START, 2).alias("planned"), F.row_number().over(w).alias("nth"))
    best = lines.where(F.col("line").rlike(BEST)).select(*by, F.row_number().over(w).alias("nth"), _n(BEST, 1, "double").alias("rmse_e"), _n(BEST, 2, "double").alias("rmse_f"))
    sizes = lines.withColumn("step", _n(SIZES, 1)).where("step is not null").groupBy(*by, "step").agg(F.max_by(_n(SIZES, 2), "pos").alias("seed_size"), F.max_by(_n(SIZES, 3), "pos").alias("training_size"))
    dom = lines.withColumn("step", _n(DOMAIN, 1)).where("step is not null")
    dom = dom.groupBy(*by, "step").agg(*[F.max_by(_n(DOMAIN, i), "pos").alias(c) for i, c in enumerate(("interpolating", "extrapolating", "out_of_domain", "in_domain", "after_filters", "frames"), 2)], F.max_by(_n(SUBMITTED, 1), "pos").alias("submitted"))
    return started.join(best, [*by, "nth"], "left").join(sizes, [*by, "step"], "left").join(dom, [*by, "step"], "left").drop("nth")
