"""Problem 3: the most similar structures of every structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.ids import SQL_KEY, SQL_TEXT, id_text
from latticework.llm import neighbours
from latticework.session import table

#: Cells looked into where no least similarity prunes: far neighbours are spread more widely.
WIDE_PROBES = 24


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest(table(spark, d, "descriptor_dict"), k=5, least=0.97)
    a, b = F.least("key", "other"), F.greatest("key", "other")
    return near.select(id_text(a).alias("id_a"), id_text(b).alias("id_b")).distinct()


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest(table(spark, d, "descriptor_dict"), k=5, probes=WIDE_PROBES)
    return near.select(id_text("key").alias("atl_id"), "rank", id_text("other").alias("neighbour"), F.round("sim", 6).alias("similarity"))


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours}
#: Brute force over all pairs.
_KEY, _TEXT = SQL_KEY.format(c="atl_id"), SQL_TEXT.format
ORACLES: dict[str, str] = {
    "p3_found": f"""with r as (select {_KEY} as key, descriptors::float[]::double[] as v, recorded_at from descriptor_dict),
g as (select * from r where key is not null and len(v) = 64 and list_bool_and(list_transform(v, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(v, lambda x: x <> 0))),
f as (select key, v from g qualify row_number() over (partition by key order by recorded_at nulls first, v) = 1),
s as (select a.key as a, b.key as b, list_cosine_similarity(a.v, b.v) as sim from f a join f b on a.key <> b.key),
k as (select a, b from s qualify row_number() over (partition by a order by sim desc, b) <= 5 and sim >= 0.97)
select distinct {_TEXT(k='least(a, b)')} as id_a, {_TEXT(k='greatest(a, b)')} as id_b from k""",
}
