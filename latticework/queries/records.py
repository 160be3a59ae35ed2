"""Queries over structure records: flag filters, reasons, ids, duplicates, cleanup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.functions import scalar as S
from latticework.operators import records as R
from latticework.queries.index import SQL_FLAGGED
from latticework.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _s(spark: SparkSession, d: str) -> DataFrame:
    return R.flagged(table(spark, d, "structures"))


@query(SQL_FLAGGED + "select key, phase from f where perturb and phase = 'alpha' union all select key, phase from f where vacancy and phase = 'alpha'")
def flag_filter_bag(spark: SparkSession, d: str) -> DataFrame:
    return R.keep_any(_s(spark, d), ["perturb", "vacancy"], phase="alpha").select("key", "phase")


@query(SQL_FLAGGED + "select key, phase from f where perturb or vacancy")
def flag_filter_set(spark: SparkSession, d: str) -> DataFrame:
    return R.keep_any(_s(spark, d), ["perturb", "vacancy"], dedupe=True).select("key", "phase")


@query(SQL_FLAGGED + "select key, phase from f where not (perturb or vacancy)")
def flag_filter_remaining(spark: SparkSession, d: str) -> DataFrame:
    return R.keep_none(_s(spark, d), ["perturb", "vacancy"]).select("key", "phase")


def _filters() -> dict:
    return {"atom_count": ~F.col("n_atoms").between(8, 32), "positive_energy": F.col("energy") > 0, "high_energy": F.try_divide("energy", "n_atoms") > -3.4, "no_phase": F.col("phase").isNull()}


_REASONS = SQL_FLAGGED + """, g as (select *, case when not isolated_atom and n_atoms not between 8 and 32 then 'atom_count' end as a, case when not isolated_atom and energy > 0 then 'positive_energy' end as b,
  case when not isolated_atom and energy / n_atoms > -3.4 then 'high_energy' end as c, case when not isolated_atom and phase is null then 'no_phase' end as e from f)
"""


@query(_REASONS + "select key, recorded_at, concat_ws(', ', a, b, c, e) as removal_reason, coalesce(a, b, c, e) as first_reason from g")
def filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    return R.with_reasons(_s(spark, d), _filters(), F.col("isolated_atom")).select("key", "recorded_at", "removal_reason", "first_reason")


@query(_REASONS + "select coalesce(a, b, c, e) as first_reason, coalesce(phase, 'unknown') as phase, coalesce(struct_type, 'unknown') as struct_type, count(*) as n from g where coalesce(a, b, c, e) is not null group by 1, 2, 3")
def filter_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    df = R.with_reasons(_s(spark, d), _filters(), F.col("isolated_atom")).where("first_reason is not null")
    return df.groupBy("first_reason", F.coalesce("phase", F.lit("unknown")).alias("phase"), F.coalesce("struct_type", F.lit("unknown")).alias("struct_type")).agg(F.count(F.lit(1)).alias("n"))


@query(SQL_FLAGGED + "select key, n_atoms from f where base or n_atoms between 10 and 30")
def size_range_keep_base(spark: SparkSession, d: str) -> DataFrame:
    return _s(spark, d).where(F.col("base") | F.col("n_atoms").between(10, 30)).select("key", "n_atoms")


@query(SQL_FLAGGED + ", t as (select labelled as scf, case when energy is null then null else energy < -50 end as ionic from f) select 'scf' as flag, count(*) filter (where scf) as n_true, count(*) filter (where not scf) as n_false, count(*) filter (where scf is null) as n_unknown from t union all select 'ionic', count(*) filter (where ionic), count(*) filter (where not ionic), count(*) filter (where ionic is null) from t")
def tri_state_counts(spark: SparkSession, d: str) -> DataFrame:
    df = _s(spark, d).select(F.col("labelled").alias("scf"), (F.col("energy") < -50).alias("ionic"))
    return R.tri_state(df, ["scf", "ionic"])


@query(SQL_FLAGGED + ", t as (select key, recorded_at, labelled as scf, energy < -50 as ionic, bulk as relax from f) select key, recorded_at, (coalesce(not scf, false) or (relax and coalesce(not ionic, false))) as drop_known, (coalesce(not scf, true) or (relax and coalesce(not ionic, true))) as drop_unknown from t")
def dft_convergence(spark: SparkSession, d: str) -> DataFrame:
    scf, ionic, relax = F.col("labelled"), F.col("energy") < -50, F.col("bulk")
    return _s(spark, d).select("key", "recorded_at", R.unconverged(scf, ionic, relax, need_ionic=True).alias("drop_known"), R.unconverged(scf, ionic, relax, need_ionic=True, drop_unknown=True).alias("drop_unknown"))


@query(SQL_FLAGGED + "select key, count(*) as n from f group by key having key is null or count(*) > 1")
def id_problems(spark: SparkSession, d: str) -> DataFrame:
    return R.id_problems(_s(spark, d)).select("key", "n")


@query(SQL_FLAGGED + ", r as (select key, atl_id, recorded_at, row_number() over (partition by key order by recorded_at, atl_id) - 1 as repeat from f) select key, recorded_at, repeat::int as repeat, (key is null or repeat > 0) as needs_id from r")
def repair_ids(spark: SparkSession, d: str) -> DataFrame:
    return R.repair_ids(_s(spark, d), "key", "recorded_at", "atl_id").select("key", "recorded_at", F.col("repeat").cast("int").alias("repeat"), "needs_id")


@query(SQL_FLAGGED + ", r as (select *, row_number() over (partition by phase, formula order by recorded_at, atl_id) as k from f) select phase, formula, key, recorded_at from r where k = 1")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    return R.keep_first(_s(spark, d), ["phase", "formula"], "recorded_at", "atl_id").select("phase", "formula", "key", "recorded_at")


_TYPE = "case when isolated_atom then 'isolated_atom' when base then 'base' when bulk then 'bulk' when surface then 'surface' when cluster then 'cluster' else 'unknown' end"


@query(SQL_FLAGGED + f"select {_TYPE} as type, coalesce(phase, 'unknown') as phase, count(*) as n, count(*) filter (where perturb) as n_perturb, count(*) filter (where vacancy) as n_vacancy, count(*) filter (where labelled) as n_labelled from f group by 1, 2")
def database_report(spark: SparkSession, d: str) -> DataFrame:
    df = _s(spark, d)
    return df.groupBy(R.database_type(df).alias("type"), F.coalesce("phase", F.lit("unknown")).alias("phase")).agg(F.count(F.lit(1)).alias("n"), F.count_if("perturb").alias("n_perturb"), F.count_if("vacancy").alias("n_vacancy"), F.count_if("labelled").alias("n_labelled"))


_CLEAN = _REASONS + """, h as (select *, coalesce(a, b, c, e) as reason from g), k as (select *, row_number() over (partition by reason is null, phase, formula, n_atoms, energy order by recorded_at, atl_id) as nth from h),
z as (select *, case when reason is not null then 'filter' when nth > 1 then 'duplicate' else 'kept' end as fate from k)
"""


@query(_CLEAN + "select fate, coalesce(reason, '') as reason, coalesce(struct_type, 'unknown') as struct_type, count(*) as n from z group by 1, 2, 3")
def cleanup_report(spark: SparkSession, d: str) -> DataFrame:
    df = R.cleanup(_s(spark, d), _filters(), ["phase", "formula", "n_atoms", "energy"], "recorded_at", "atl_id")
    return df.groupBy("fate", F.coalesce("first_reason", F.lit("")).alias("reason"), F.coalesce("struct_type", F.lit("unknown")).alias("struct_type")).agg(F.count(F.lit(1)).alias("n"))


@query(_CLEAN + "select key, recorded_at from z where fate = 'kept'")
def cleanup_kept(spark: SparkSession, d: str) -> DataFrame:
    return R.cleanup(_s(spark, d), _filters(), ["phase", "formula", "n_atoms", "energy"], "recorded_at", "atl_id").where("fate = 'kept'").select("key", "recorded_at")


_COMP = "list_sort(list_transform(regexp_extract_all(formula, '([A-Z][a-z]?)(\\d*)'), lambda x: regexp_extract(x, '^([A-Z][a-z]?)', 1) || ':' || coalesce(nullif(regexp_extract(x, '(\\d+)$', 1), ''), '1')))"


@query(f"select atl_id, recorded_at, array_to_string({_COMP}, ',') as composition from structures where formula is not null")
def composition_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "structures").where("formula is not null").select("atl_id", "recorded_at", S.composition_key("formula").alias("composition"))


_FRAC = "(coalesce(try_cast(nullif(regexp_extract(formula, 'Ni(\\d+)', 1), '') as int), case when contains(formula, 'Ni') then 1 else 0 end) / list_sum(list_transform(regexp_extract_all(formula, '[A-Z][a-z]?\\d*'), lambda x: coalesce(try_cast(nullif(regexp_extract(x, '(\\d+)$', 1), '') as int), 1))))"


@query(f"select atl_id, recorded_at, round({_FRAC}, 6) as share, {_FRAC} > 0.5 - 0.1 and {_FRAC} < 0.75 + 0.1 as in_range from structures where formula is not null")
def element_share(spark: SparkSession, d: str) -> DataFrame:
    share = S.element_fraction("formula", "Ni")
    return table(spark, d, "structures").where("formula is not null").select("atl_id", "recorded_at", F.round(share, 6).alias("share"), S.in_range(share, 0.5, 0.75, 0.1).alias("in_range"))


@query("select distinct regexp_extract(x, '^([A-Z][a-z]?)', 1) as element from (select unnest(regexp_extract_all(formula, '[A-Z][a-z]?\\d*')) as x from structures)")
def species(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "structures").where("formula is not null").select(F.explode(F.transform(S.composition("formula"), lambda p: p["element"])).alias("element")).distinct()


@query(SQL_FLAGGED + "select key, recorded_at, coalesce(struct_type, case when bulk then 'bulk' when surface then 'surface' end, 'unknown') as type, '[' || array_to_string(list_filter([case when perturb then '\"perturb\"' end, case when deformation then '\"deformation\"' end, case when vacancy then '\"vacancy\"' end, case when replacement then '\"replacement\"' end], lambda x: x is not null), ',') || ']' as modifications from f")
def derived_labels(spark: SparkSession, d: str) -> DataFrame:
    df = _s(spark, d)
    kind = S.struct_type(F.col("struct_type"), [(t, F.col(t)) for t in ("bulk", "surface")])
    return df.select("key", "recorded_at", kind.alias("type"), S.flag_names([(m, F.col(m)) for m in R.MODIFICATIONS]).alias("modifications"))


@query(SQL_FLAGGED + ", p as (select *, row_number() over (partition by phase order by base desc, n_atoms, recorded_at, atl_id) as k from f where phase is not null) select phase, key, base, n_atoms from p where k = 1")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    df = _s(spark, d).where("phase is not null")
    return R.keep_first(df, ["phase"], F.desc("base"), F.asc_nulls_last("n_atoms"), "recorded_at", "atl_id").select("phase", "key", "base", "n_atoms")


@query(SQL_FLAGGED + ", c as (select distinct phase, formula, n_atoms, energy, key, recorded_at, atl_id from f where energy is not null), m as (select *, first_value(energy) over w as first_energy from c window w as (partition by phase, formula order by recorded_at, atl_id, energy)) select key, recorded_at from m where abs(energy - first_energy) <= 1e-6 + 1e-5 * abs(first_energy)")
def close_to_first(spark: SparkSession, d: str) -> DataFrame:
    df = _s(spark, d).where("energy is not null").select("phase", "formula", "n_atoms", "energy", "key", "recorded_at", "atl_id").distinct()
    first = F.first("energy").over(Window.partitionBy("phase", "formula").orderBy("recorded_at", "atl_id", "energy"))
    return df.withColumn("fe", first).where(F.abs(F.col("energy") - F.col("fe")) <= 1e-6 + 1e-5 * F.abs("fe")).select("key", "recorded_at")
