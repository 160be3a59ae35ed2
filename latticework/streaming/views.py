"""Optional views that stay current: our own extension, as the batch operators are what is defined.

Each view is a plan over a streaming DataFrame; on a finished input it equals its batch counterpart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.sources import logs, tables


def log_starts(spark: SparkSession, folder: str) -> DataFrame:
    """The iterations that logs in a folder have started, as the lines come."""
    lines = spark.readStream.text(folder).select(F.col("value").alias("line"))
    step = F.nullif(F.regexp_extract("line", logs.START, 1), F.lit("")).cast("long")
    return lines.select(step.alias("step"), F.nullif(F.regexp_extract("line", logs.START, 2), F.lit("")).cast("long").alias("planned")).where("step is not null")


def counters(stream: DataFrame, by: list[str], value: str) -> DataFrame:
    """Running totals per key, for update mode."""
    return stream.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def windowed(stream: DataFrame, at: str, value: str, width: str, late: str) -> DataFrame:
    """Totals per time window; rows later than ``late`` are left out, which bounds the state."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def keep_current(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str):
    """Keep a stored table with the latest row of each key by ``order``, whenever it arrives; returns the running query."""

    def merge(batch: DataFrame, _: int) -> None:
        from latticework.operators.records import keep_first

        spark = batch.sparkSession
        rows = batch.unionByName(tables.read(spark, path)) if tables.exists(spark, path) else batch
        tables.write(keep_first(rows, key, F.desc(order)), path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
