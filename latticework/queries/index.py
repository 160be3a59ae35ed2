"""Queries over the project index: counts, breakdowns, listings, maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.functions import scalar as S
from latticework.functions.ids import SQL_KEY, id_key
from latticework.operators import records as R
from latticework.session import table

QUERIES, ORACLES = {}, {}

#: SQL of the plain form of a label, of the list of modifications, and of a stamp.
LABEL = "nullif(regexp_replace(lower(trim({c})), '[\\s_]+', '_', 'g'), '')"
MODS = "coalesce(list_transform(regexp_extract_all(modifications, '\"([^\"]+)\"', 1), lambda x: lower(x)), [])"
KEY = SQL_KEY.format(c="atl_id")
SQL_FLAGGED = f"""with s as (select {KEY} as key, atl_id, formula, n_atoms, {LABEL.format(c='phase')} as phase, {LABEL.format(c='struct_type')} as struct_type,
  {MODS} as mods, calc_performed = 1 as labelled, calc_energy as energy, recorded_at, removed_at, created_at from structures),
f as (select *, list_contains(mods, 'perturb') as perturb, list_contains(mods, 'deformation') as deformation, list_contains(mods, 'vacancy') as vacancy,
  list_contains(mods, 'replacement') as replacement, coalesce(struct_type = 'bulk', false) as bulk, coalesce(struct_type = 'surface', false) as surface,
  coalesce(struct_type = 'cluster', false) as cluster, coalesce(struct_type = 'isolated_atom', false) as isolated_atom, len(mods) = 0 as base from s)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("select count(*) as total, coalesce(sum(case when calc_performed = 1 then 1 else 0 end), 0)::bigint as labelled, coalesce(sum(case when calc_performed = 1 then 0 else 1 end), 0)::bigint as unlabelled from structures")
def index_counts(spark: SparkSession, d: str) -> DataFrame:
    done = F.coalesce(F.col("calc_performed") == 1, F.lit(False))
    return table(spark, d, "structures").agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("labelled"), F.count_if(~done).alias("unlabelled"))


def _breakdown(column: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "structures").groupBy(column).count().select(F.coalesce(column, F.lit("unknown")).alias("value"), F.col("count").alias("n"))

    return run


for _c in ("phase", "struct_type", "formula"):
    QUERIES[f"index_by_{_c}"] = _breakdown(_c)
    ORACLES[f"index_by_{_c}"] = f"select coalesce({_c}, 'unknown') as value, n from (select {_c}, count(*) as n from structures group by {_c})"


@query(SQL_FLAGGED + "select m as modification, count(*) as n from (select unnest(mods) as m from f) group by m")
def index_modifications(spark: SparkSession, d: str) -> DataFrame:
    return R.flagged(table(spark, d, "structures")).select(F.explode("mods").alias("modification")).groupBy("modification").agg(F.count(F.lit(1)).alias("n"))


@query("select atl_id, n_atoms from structures where n_atoms is not null")
def index_atom_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "structures").where("n_atoms is not null").select("atl_id", "n_atoms")


@query("""with a as (select n_atoms from structures where n_atoms is not null), p as (select min(n_atoms) as lo, max(n_atoms) as hi, least(greatest(10, count(distinct n_atoms) // 2), 50) as k, median(n_atoms) as med from a)
select least(k - 1, case when hi = lo then 0 else cast(floor((n_atoms - lo) * k / (hi - lo)::double) as bigint) end)::bigint as bin, count(*) as n, max(med)::double as median from a, p group by 1""")
def index_atoms_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "structures").where("n_atoms is not null").groupBy("n_atoms").count()  # few distinct sizes from here on
    total = F.sum("count")
    shape = rows.agg(F.min("n_atoms").alias("lo"), F.max("n_atoms").alias("hi"), F.least(F.greatest(F.lit(10), F.floor(F.count(F.lit(1)) / 2)), F.lit(50)).alias("k"), total.alias("total"))
    run = F.sum("count").over(Window.orderBy("n_atoms"))
    ranked = rows.withColumn("upto", run)
    mid = ranked.join(F.broadcast(shape)).agg(((F.min(F.when(F.col("upto") >= F.ceil(F.col("total") / 2), F.col("n_atoms"))) + F.min(F.when(F.col("upto") >= F.floor(F.col("total") / 2) + 1, F.col("n_atoms")))) / 2).cast("double").alias("median"))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.floor((F.col("n_atoms") - F.col("lo")) * F.col("k") / (F.col("hi") - F.col("lo")).cast("double")))
    return rows.join(F.broadcast(shape)).withColumn("bin", F.least(F.col("k") - 1, b).cast("long")).groupBy("bin").agg(F.sum("count").alias("n")).join(F.broadcast(mid))


@query("with g as (select phase, count(*) as n from structures group by phase) select coalesce(phase, 'unknown') as value, n, round(n / sum(n) over (), 6) as share from g")
def index_phase_shares(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "structures").groupBy("phase").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.coalesce("phase", F.lit("unknown")).alias("value"), "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("share"))


@query("select status, count(*) as n from al_runs group by status")
def index_al_runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "al_runs").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("select lower(status) as status, count(*) as n, count(distinct calc_uuid) as n_runs from dft_runs group by 1")
def index_dft_runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dft_runs").groupBy(F.lower("status").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("calc_uuid").alias("n_runs"))


@query("select max(id) as id from al_runs")
def index_latest_run(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "al_runs").agg(F.max("id").alias("id"))


@query("select atl_id, recorded_at from structures order by recorded_at desc, atl_id limit 50")
def index_list_newest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "structures").select("atl_id", "recorded_at").orderBy(F.desc("recorded_at"), "atl_id").limit(50)


@query(SQL_FLAGGED + "select atl_id, n_atoms, recorded_at from f where (contains(lower(coalesce(formula, '')), 'ni') or contains(coalesce(phase, ''), 'ni')) and phase in ('alpha', 'gamma') and struct_type in ('bulk', 'surface') and (len(mods) = 0 or list_has_any(mods, ['vacancy'])) and (n_atoms is null or n_atoms between 4 and 40)")
def index_filter(spark: SparkSession, d: str) -> DataFrame:
    df = R.flagged(table(spark, d, "structures"))
    text = F.lower(F.coalesce("formula", F.lit(""))).contains("ni") | F.coalesce("phase", F.lit("")).contains("ni")
    keep = text & F.col("phase").isin("alpha", "gamma") & F.col("struct_type").isin("bulk", "surface") & (F.col("base") | F.arrays_overlap("mods", F.array(F.lit("vacancy"))))
    return df.where(keep & (F.col("n_atoms").isNull() | F.col("n_atoms").between(4, 40))).select("atl_id", "n_atoms", "recorded_at")


@query(f"""with r as (select {KEY} as key, * exclude (atl_id), row_number() over (partition by {KEY} order by recorded_at desc, removed_at is null desc, atl_id, coalesce(formula, ''), coalesce(n_atoms, -1), coalesce(calc_performed, -1)) as k from structures)
select key, formula, n_atoms, calc_performed, recorded_at from r where k = 1 and key is not null""")
def index_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "structures").withColumn("key", id_key("atl_id")).where("key is not null")
    last = R.keep_first(df, ["key"], F.desc("recorded_at"), F.desc(F.col("removed_at").isNull()), "atl_id", F.coalesce("formula", F.lit("")), F.coalesce("n_atoms", F.lit(-1)), F.coalesce("calc_performed", F.lit(-1)))
    return last.select("key", "formula", "n_atoms", "calc_performed", "recorded_at")


@query("""with o as (select run_id, iteration, max(db_size) as db_size, max(rmse_e) as rmse_e, min(refreshed_at) as refreshed_at from al_iterations where iteration <= 5 group by 1, 2),
n as (select run_id, iteration, max(db_size) + 1 as db_size, cast(null as double) as rmse_e, max(refreshed_at) as refreshed_at from al_iterations where iteration >= 4 group by 1, 2)
select coalesce(o.run_id, n.run_id) as run_id, coalesce(o.iteration, n.iteration) as iteration, case when n.run_id is not null then n.db_size else o.db_size end as db_size,
case when n.run_id is not null then n.rmse_e else o.rmse_e end as rmse_e, coalesce(o.refreshed_at, n.refreshed_at) as refreshed_at from o full outer join n on o.run_id = n.run_id and o.iteration = n.iteration""")
def index_upsert_iterations(spark: SparkSession, d: str) -> DataFrame:
    it = table(spark, d, "al_iterations")
    part = lambda df, size, err, stamp: df.groupBy("run_id", "iteration").agg(size.alias("db_size"), err.alias("rmse_e"), stamp("refreshed_at").alias("refreshed_at"))
    old = part(it.where("iteration <= 5"), F.max("db_size"), F.max("rmse_e"), F.min)
    new = part(it.where("iteration >= 4"), F.max("db_size") + 1, F.max(F.lit(None).cast("double")), F.max)
    return R.upsert(old, new, ["run_id", "iteration"], keep=["refreshed_at"])


@query("select section, max(id) as active_id, count(*) as n_snapshots, coalesce(sum(is_active), 0)::bigint as n_marked from config_snapshots group by section")
def index_active_config(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "config_snapshots").groupBy("section").agg(F.max("id").alias("active_id"), F.count(F.lit(1)).alias("n_snapshots"), F.coalesce(F.sum("is_active"), F.lit(0)).cast("long").alias("n_marked"))


@query(f"""with gone as (select distinct {KEY} as key from structures where removed_at is not null)
select calc_uuid, case when {KEY} in (select key from gone where key is not null) then null else {KEY} end as key, lower(status) as status from dft_runs""")
def index_unlink_removed(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "structures").where("removed_at is not null").select(id_key("atl_id").alias("key")).where("key is not null").distinct().withColumn("gone", F.lit(True))
    runs = table(spark, d, "dft_runs").select("calc_uuid", id_key("atl_id").alias("key"), F.lower("status").alias("status"))
    return runs.join(gone, "key", "left").select("calc_uuid", F.when(F.col("gone").isNull(), F.col("key")).alias("key"), "status")


@query("""select r.id as run_id, r.status, case when count(i.iteration) = 0 then 'empty' when r.finished_at is null then 'running' else 'finished' end as derived
from al_runs r left join al_iterations i on r.id = i.run_id group by r.id, r.status, r.finished_at""")
def index_run_states(spark: SparkSession, d: str) -> DataFrame:
    its = table(spark, d, "al_iterations").where("run_id is not null").groupBy("run_id").agg(F.count("iteration").alias("k"))
    runs = table(spark, d, "al_runs").select(F.col("id").alias("run_id"), "status", "finished_at").join(its, "run_id", "left")
    state = F.when(F.coalesce("k", F.lit(0)) == 0, "empty").when(F.col("finished_at").isNull(), "running").otherwise("finished")
    return runs.select("run_id", "status", state.alias("derived"))


@query("""with s as (select (select count(*) from structures) as a, (select count(*) from structures where calc_performed = 1) as b, (select count(*) from dft_runs where lower(status) = 'finished') as c, (select count(*) from al_runs) as e)
select 'database' as stage, case when a > 0 then 'done' else 'open' end as state from s union all select 'labels', case when b = 0 then 'open' when b < a then 'partly' else 'done' end from s
union all select 'runs', case when c > 0 then 'done' else 'open' end from s union all select 'loop', case when e > 0 then 'done' else 'open' end from s""")
def index_workflow_state(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "structures").agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("calc_performed") == 1).alias("b"))
    r = table(spark, d, "dft_runs").agg(F.count_if(F.lower("status") == "finished").alias("c"))
    one = s.join(F.broadcast(r)).join(F.broadcast(table(spark, d, "al_runs").agg(F.count(F.lit(1)).alias("e"))))
    some = lambda c: F.when(F.col(c) > 0, "done").otherwise("open")
    parts = [("database", some("a")), ("labels", F.when(F.col("b") == 0, "open").when(F.col("b") < F.col("a"), "partly").otherwise("done")), ("runs", some("c")), ("loop", some("e"))]
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("stage"), x.alias("state")) for n, x in parts])))


@query(f"""with d as (select distinct {KEY} as key from dft_runs) select count(*) filter (where key is not null) as n_ids, count(*) filter (where key in (select {KEY} from structures where {KEY} is not null)) as n_known from d""")
def index_known_references(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "dft_runs").select(id_key("atl_id").alias("key")).where("key is not null").distinct()
    known = table(spark, d, "structures").select(id_key("atl_id").alias("key")).where("key is not null").distinct().withColumn("known", F.lit(1))
    return ids.join(known, "key", "left").agg(F.count(F.lit(1)).alias("n_ids"), F.count("known").alias("n_known"))


@query("""with t as (select id, try_cast(replace(regexp_replace(started_at, '(Z|\\+00:00)$', ''), 'T', ' ') as timestamp) as a, try_cast(replace(regexp_replace(finished_at, '(Z|\\+00:00)$', ''), 'T', ' ') as timestamp) as b from al_runs)
select id, a as started, b as finished, round(epoch(b - a), 3) as seconds from t""")
def index_run_spans(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "al_runs").select("id", S.parse_stamp("started_at").alias("started"), S.parse_stamp("finished_at").alias("finished"))
    sec = F.round((F.unix_micros("finished") - F.unix_micros("started")) / 1e6, 3)
    return t.select("id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("finished").cast("timestamp_ntz").alias("finished"), sec.alias("seconds"))
