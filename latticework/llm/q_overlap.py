"""Problem 2: overlaps between train and the evaluation splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.ids import SQL_KEY, SQL_TEXT, id_text
from latticework.llm import overlap
from latticework.session import materialise, table


def _found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "split_members"), table(spark, d, "descriptor_dict"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.least("train_key", "eval_key"), F.greatest("train_key", "eval_key")
    return _found(spark, d).select(F.col("split").alias("split_name"), id_text(a).alias("id_a"), id_text(b).alias("id_b")).distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(materialise(_found(spark, d), "overlaps"), table(spark, d, "split_members"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
#: Near-same sets have equally many points, means within the tolerance, and every point a partner on the other side. That is all a pairing
#: needs but its being one to one; where it is not (points closer to each other than the tolerance), the twin may name more pairs than there are.
_KEY, _TEXT = SQL_KEY.format(c="atl_id"), SQL_TEXT.format
_NEAR = "list_bool_and(list_transform({a}, lambda p: list_bool_or(list_transform({b}, lambda q: abs(p[1] - q[1]) <= 0.005000000005 and abs(p[2] - q[2]) <= 0.005000000005))))"
_SQL = f"""with r as (select {_KEY} as key, lower(regexp_replace(split_name, '[\\s\u200b]+', '', 'g')) as split, coalesce(source, 'unknown') as source from split_members),
m as (select distinct key, split, source from r where key is not null and split in ('train', 'valid', 'test')), w as (select distinct key, split from m),
s as (select distinct {_KEY} as key, latent_space::float[][]::double[][] as p from descriptor_dict where len(latent_space) >= 8),
f as (select key, p, len(p) as n, list_avg(list_transform(p, lambda x: x[1])) as mx, list_avg(list_transform(p, lambda x: x[2])) as my from s where key is not null and list_bool_and(list_transform(p, lambda x: len(x) = 2 and isfinite(x[1]) and isfinite(x[2])))),
t as (select w.key, f.* exclude key from w join f using (key) where split = 'train'), e as (select w.split, w.key, f.* exclude key from w join f using (key) where split <> 'train'),
near as (select distinct e.split, t.key as train_key, e.key as eval_key from t join e on t.n = e.n and t.key <> e.key and abs(t.mx - e.mx) <= 0.005001 and abs(t.my - e.my) <= 0.005001 where {_NEAR.format(a='t.p', b='e.p')} and {_NEAR.format(a='e.p', b='t.p')}),
found as (select * from near union all select a.split, a.key, a.key from w a join w b on a.key = b.key and b.split = 'train' where a.split <> 'train')
"""
ORACLES: dict[str, str] = {
    "p2_found": _SQL + f"select distinct split as split_name, {_TEXT(k='least(train_key, eval_key)')} as id_a, {_TEXT(k='greatest(train_key, eval_key)')} as id_b from found",
    "p2_report": _SQL
    + """, per as (select split, eval_key, max((train_key = eval_key)::int) as same, max((train_key <> eval_key)::int) as near_, count(*) as pairs from found group by 1, 2)
select m.split as split_name, m.source, count(*) as n_members, sum(coalesce(same, 0))::bigint as n_same_id, sum(coalesce(near_, 0))::bigint as n_near_same, sum(coalesce(pairs, 0))::bigint as n_pairs, sum((coalesce(same, 0) + coalesce(near_, 0) > 0)::int)::bigint as n_overlapping
from m left join per on per.split = m.split and per.eval_key = m.key where m.split <> 'train' group by 1, 2""",
}
