"""Problem 7: a collection with target shares of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import mixing
from latticework.session import table


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_rules(spark: SparkSession, d: str) -> DataFrame:
    """Per source its distinct texts; uses beyond the permitted number, and sources that the total was sought for but miss their quota by more than their longest document: none."""
    used, told = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    longest = used.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    both = told.join(longest, "source", "left").withColumn("slack", F.coalesce("longest", F.lit(0)))
    missed = F.col("holds_total") & (F.col("shortfall_tokens") > F.col("slack"))
    return both.select("source", F.col("documents_there").alias("n_texts"), (F.col("most_uses") > F.col("max_repeats")).alias("over_used"), missed.alias("missed"))


QUERIES = {"p7_mix": p7_mix, "p7_report": p7_report, "p7_rules": p7_rules}
ORACLES: dict[str, str] = {
    "p7_rules": "with t as (select distinct lower(trim(source)) as source from mix_targets where trim(source) <> ''), d as (select lower(trim(source)) as source, count(distinct text) as n from documents where text <> '' group by 1) select t.source, coalesce(d.n, 0) as n_texts, false as over_used, false as missed from t left join d on d.source = t.source"
}
