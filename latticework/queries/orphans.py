"""Problem 1 over the project tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.ids import SQL_KEY, id_key
from latticework.operators import orphans as op
from latticework.session import materialise, table


def _parts(spark: SparkSession, d: str, least: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    runs, structures = table(spark, d, "dft_runs"), table(spark, d, "structures")
    refs = materialise(op.references(runs, F.col("calc_uuid"), id_key("atl_id"), F.col("recorded_at")), "refs")
    present = materialise(op.presence(structures, id_key("atl_id"), F.col("recorded_at"), F.col("removed_at")), "present")
    groups = materialise(op.counted(refs), "groups")
    heavy = op.heavy_keys(groups, least)
    groups = materialise(op.judged(groups, present, heavy), "judged")
    return refs, present, *op.orphans(refs, present, groups, heavy)


def p1_found(spark: SparkSession, d: str, least: int = op.HEAVY_LEAST) -> DataFrame:
    return _parts(spark, d, least)[2].select(F.col("ident").alias("calc_uuid"))


def p1_report(spark: SparkSession, d: str, least: int = op.HEAVY_LEAST) -> DataFrame:
    refs, present, _, lost = _parts(spark, d, least)
    return op.orphan_report(refs, present, lost, "dft_runs")


def p1_report_split(spark: SparkSession, d: str) -> DataFrame:
    """The report with the split forced at a size where no key is heavy by itself."""
    return p1_report(spark, d, least=20)


_SQL = f"""
with r as (select calc_uuid, {SQL_KEY.format(c='atl_id')} as k, recorded_at as t from dft_runs where calc_uuid is not null and recorded_at is not null),
f as (select calc_uuid, k, t from (select *, row_number() over (partition by calc_uuid order by t, (k is null), k) as n from r) where n = 1),
s as (select {SQL_KEY.format(c='atl_id')} as k, recorded_at as a, coalesce(removed_at, timestamp '9999-12-31') as b from structures),
o as (select * from f where k is not null and not exists (select 1 from s where s.k = f.k and s.a <= f.t and s.b > f.t))
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_report_split": p1_report_split}
ORACLES = {
    "p1_found": _SQL + "select calc_uuid from o",
    "p1_report": _SQL
    + """, x as (select k, min(a) as a from s where a < b group by k),
q as (select strftime(o.t, '%Y-%m') as period, count(*) as n_orphans, count(*) filter (where x.a is null) as n_never,
  count(*) filter (where o.t < x.a) as n_later, count(*) filter (where o.t >= x.a) as n_removed from o left join x on o.k = x.k group by 1),
p as (select strftime(t, '%Y-%m') as period, count(*) as n_records, count(k) as n_references from f group by 1)
select 'dft_runs' as table_name, p.period, n_records, n_references, coalesce(n_orphans, 0) as n_orphans, coalesce(n_never, 0) as n_never,
  coalesce(n_later, 0) as n_later, coalesce(n_removed, 0) as n_removed from p left join q on p.period = q.period""",
}
ORACLES["p1_report_split"] = ORACLES["p1_report"]
