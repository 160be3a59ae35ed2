"""Problem 5: varied subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.ids import SQL_KEY, id_text
from latticework.llm import subset
from latticework.session import materialise, table


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return subset.candidates(table(spark, d, "structures"), table(spark, d, "descriptor_dict"))


def _asked(spark: SparkSession, d: str) -> list[tuple]:
    return subset.asked(table(spark, d, "subset_requests"))


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate of every request with the selected structure that stands for it; those with ``selected`` are the subset."""
    rows, requests = materialise(_candidates(spark, d), "candidates"), _asked(spark, d)
    got = subset.represented(rows, requests, subset.subsets(rows, requests))
    return got.select("request_id", id_text("key").alias("atl_id"), id_text("representative").alias("representative"), F.round("distance", 4).alias("distance"), "selected")


def p5_subset(spark: SparkSession, d: str) -> DataFrame:
    chosen = subset.subsets(_candidates(spark, d), _asked(spark, d))
    return chosen.select("request_id", id_text("key").alias("atl_id"), "phase", "struct_type", F.round("mean_distance", 4).alias("mean_distance"), F.round("least_distance", 4).alias("least_distance"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    rows, requests = materialise(_candidates(spark, d), "candidates"), _asked(spark, d)
    return subset.subset_report(rows, requests, subset.subsets(rows, requests))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per request what could be selected, what was, and that selected structures stand for themselves."""
    got = p5_members(spark, d)
    own = F.count_if(F.col("selected") & ((F.col("atl_id") != F.col("representative")) | (F.col("distance") > 0)))
    return got.groupBy("request_id").agg(F.countDistinct("atl_id").alias("n_available"), F.count_if("selected").alias("n_selected"), own.alias("n_represented_by_others"))


QUERIES = {"p5_members": p5_members, "p5_subset": p5_subset, "p5_report": p5_report, "p5_counts": p5_counts}
_KEY = SQL_KEY.format(c="atl_id")
_NAME = "replace(nullif(trim(regexp_replace(lower({c}), '[\\s_\u200b\u00a0]+', ' ', 'g')), ''), ' ', '_')"
ORACLES: dict[str, str] = {
    "p5_counts": f"""with r as (select {_KEY} as key, {_NAME.format(c='phase')} as phase, {_NAME.format(c='struct_type')} as kind, phase as p, struct_type as t, recorded_at, removed_at from structures),
c as (select * from r where key is not null qualify row_number() over (partition by key order by recorded_at desc nulls last, (removed_at is null) desc, removed_at desc nulls last, p desc nulls last, t desc nulls last) = 1),
v as (select distinct {_KEY} as key from descriptor_dict where len(descriptors) = 64 and list_bool_and(list_transform(descriptors, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(descriptors, lambda x: x <> 0))),
a as (select c.* from c join v on c.key = v.key where removed_at is null)
select request_id, count(*) as n_available, least(max(subset_size), count(*)) as n_selected, 0::bigint as n_represented_by_others
from subset_requests q join a on ({_NAME.format(c='q.phase')} is null or {_NAME.format(c='q.phase')} = a.phase) and ({_NAME.format(c='q.struct_type')} is null or {_NAME.format(c='q.struct_type')} = a.kind) where subset_size > 0 group by 1"""
}
