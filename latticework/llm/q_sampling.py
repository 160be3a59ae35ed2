"""Problem 4: samples with target shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.ids import SQL_KEY, id_text
from latticework.llm import sampling
from latticework.session import table


def _draw(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return sampling.draw(table(spark, d, "structures"), table(spark, d, "sampling_targets"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return _draw(spark, d)[0].select("request_id", id_text("key").alias("atl_id"), "phase", "struct_type", F.to_json("modifications").alias("modifications"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _draw(spark, d)[1]


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per request the distinct structures drawn: the size asked for, or all there are."""
    drawn = _draw(spark, d)[0]
    return drawn.groupBy("request_id").agg(F.count(F.lit(1)).alias("drawn_rows"), F.countDistinct("key").alias("distinct_ids"))


QUERIES = {"p4_sample": p4_sample, "p4_report": p4_report, "p4_totals": p4_totals}
ORACLES: dict[str, str] = {
    "p4_totals": f"""with r as (select {SQL_KEY.format(c='atl_id')} as key, recorded_at, removed_at from structures),
c as (select * from r where key is not null qualify row_number() over (partition by key order by recorded_at desc nulls last, (removed_at is null) desc) = 1), n as (select count(*) as n from c where removed_at is null)
select request_id, least(max(sample_size), max(n)) as drawn_rows, least(max(sample_size), max(n)) as distinct_ids from sampling_targets, n group by 1"""
}
