"""Queries of the active-learning side: committee decisions, errors, selections, performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.operators import committee as C
from latticework.operators import selection as K
from latticework.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _preds(spark: SparkSession, d: str) -> DataFrame:
    """Predictions (frame, model, energy, force components): lineitem by its roles, supplier mod 4 as the model."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("atom"), (F.col("l_suppkey") % 4).alias("model"), F.col("l_quantity").alias("energy"), F.col("l_discount").alias("fx"), F.col("l_tax").alias("fy"), (F.col("l_extendedprice") / 1e5).alias("fz"))


P = "p as (select l_orderkey as frame, l_linenumber as atom, l_suppkey % 4 as model, l_quantity as energy, l_discount as fx, l_tax as fy, l_extendedprice / 1e5 as fz from lineitem)"


@query(f"with {P} select frame, round(coalesce(stddev_samp(energy), 0), 6) as spread, count(energy) as n_models from p group by frame")
def committee_energy_std(spark: SparkSession, d: str) -> DataFrame:
    return C.spread(_preds(spark, d), ["frame"], "energy").select("frame", F.round("spread", 6).alias("spread"), "n_models")


@query(f"with {P} select frame, round(var_pop(energy), 6) as v_energy, round(var_pop(fz), 6) as v_force from p group by frame")
def committee_variance(spark: SparkSession, d: str) -> DataFrame:
    return _preds(spark, d).groupBy("frame").agg(F.round(F.var_pop("energy"), 6).alias("v_energy"), F.round(F.var_pop("fz"), 6).alias("v_force"))


@query(f"with {P} select frame, round(max(sqrt(fx*fx+fy*fy+fz*fz)), 4) as max_force, round(avg(sqrt(fx*fx+fy*fy+fz*fz)), 4) as mean_force from p group by frame")
def committee_force_size(spark: SparkSession, d: str) -> DataFrame:
    size = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy") + F.col("fz") * F.col("fz"))
    return _preds(spark, d).groupBy("frame").agg(F.round(F.max(size), 4).alias("max_force"), F.round(F.avg(size), 4).alias("mean_force"))


@query(f"with {P}, s as (select frame, model, sum(fx) as fx, sum(fy) as fy from p group by 1, 2) select frame, round(coalesce(stddev_samp(fx), 0), 6) as sx, round(coalesce(stddev_samp(fy), 0), 6) as sy from s group by frame")
def committee_force_std(spark: SparkSession, d: str) -> DataFrame:
    s = _preds(spark, d).groupBy("frame", "model").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    return s.groupBy("frame").agg(F.round(F.coalesce(F.stddev_samp("fx"), F.lit(0.0)), 6).alias("sx"), F.round(F.coalesce(F.stddev_samp("fy"), F.lit(0.0)), 6).alias("sy"))


@query(f"with {P}, s as (select frame, coalesce(stddev_samp(energy), 0) as e, coalesce(stddev_samp(fz), 0) as f from p group by frame) select frame, (e >= 15.015 and e < 150.15) or (f >= 0.2 and f < 2.0) as flag from s")
def flag_training(spark: SparkSession, d: str) -> DataFrame:
    s = _preds(spark, d).groupBy("frame").agg(F.coalesce(F.stddev_samp("energy"), F.lit(0.0)).alias("e"), F.coalesce(F.stddev_samp("fz"), F.lit(0.0)).alias("f"))
    return s.select("frame", (C.flag_training(F.col("e"), 10.01, 12.0, 1.5) | C.flag_training(F.col("f"), 0.1, 0.2, 1.5)).alias("flag"))


@query(f"with {P}, s as (select frame, coalesce(stddev_samp(energy), 0) as e from p group by frame), m as (select avg(e) as a, stddev_samp(e) as b from s) select frame, e >= a + 1.5 * b and e < a + 10 * b as flag from s, m")
def flag_md_threshold(spark: SparkSession, d: str) -> DataFrame:
    s = C.spread(_preds(spark, d), ["frame"], "energy")
    return C.flag_threshold(s, "spread", low=1.5).select("frame", "flag")


@query(f"with {P}, s as (select frame, max(fz) as u from p group by frame), m as (select avg(u) as a, stddev_pop(u) as b from s) select frame, u >= a + 1.2 * b as flag from s, m")
def flag_confidence(spark: SparkSession, d: str) -> DataFrame:
    s = _preds(spark, d).groupBy("frame").agg(F.max("fz").alias("u"))
    return C.flag_confidence(s, "u", 1.2).select("frame", "flag")


@query("with r as (select run_id, iteration, max(rmse_e) as e, max(rmse_f) as f from al_iterations group by 1, 2) select run_id, iteration, coalesce(row_number() over (partition by run_id order by e + 0.1 * f nulls last, iteration) = 1 and e + 0.1 * f is not null, false) as best from r where run_id is not null")
def best_model(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "al_iterations").where("run_id is not null").groupBy("run_id", "iteration").agg(F.max("rmse_e").alias("e"), F.max("rmse_f").alias("f"))
    score = F.col("e") + 0.1 * F.col("f")
    w = Window.partitionBy("run_id").orderBy(F.asc_nulls_last(score), "iteration")
    return r.select("run_id", "iteration", ((F.row_number().over(w) == 1) & score.isNotNull()).alias("best"))


@query("with r as (select run_id, iteration, max(rmse_e) as e, max(rmse_f) as f from al_iterations group by 1, 2) select run_id, iteration, round(e + 0.1 * f, 6) as score from r where e + 0.1 * f is not null order by e + 0.1 * f, run_id, iteration limit 1")
def best_model_overall(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "al_iterations").groupBy("run_id", "iteration").agg(F.max("rmse_e").alias("e"), F.max("rmse_f").alias("f"))
    return C.best_model(r, "e", "f", 0.1, "run_id", "iteration").where("best").select("run_id", "iteration", F.round(F.col("e") + 0.1 * F.col("f"), 6).alias("score"))


@query("with q as (select o_orderstatus as s, quantile_cont(o_totalprice, 0.3) as a, quantile_cont(o_totalprice, 0.7) as b from orders group by 1) select o_orderkey as id, case when o_totalprice >= a - 0.8 * (b - a) and o_totalprice <= b + 0.8 * (b - a) then o_totalprice end as kept from orders join q on o_orderstatus = s")
def iqr_mask(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice")
    return C.iqr_mask(o, "o_totalprice", ["o_orderstatus"], reach=0.8).select("id", "kept")


@query(f"with {P} select model, round(avg(abs(energy - 25)), 6) as mae_energy, round(sqrt(avg((energy - 25) * (energy - 25))), 6) as rmse_energy, round(avg(abs(fx - fy)), 6) as mae_force, round(sqrt(avg((fx - fy) * (fx - fy))), 6) as rmse_force from p group by model")
def error_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = C.error_metrics(_preds(spark, d), {"energy": (F.col("energy"), F.lit(25.0)), "force": (F.col("fx"), F.col("fy"))}, ["model"])
    return m.select("model", *[F.round(c, 6).alias(c) for c in m.columns if c != "model"])


@query(f"with {P}, s as (select frame, avg(energy - 25) as de, sqrt(avg(fz * fz)) as rf from p group by frame) select round(avg(abs(de)), 6) as mae, round(stddev_pop(de), 6) as std_energy, round(avg(rf), 6) as mean_force, round(stddev_pop(rf), 6) as std_force from s")
def database_evaluation(spark: SparkSession, d: str) -> DataFrame:
    s = _preds(spark, d).groupBy("frame").agg(F.avg(F.col("energy") - 25).alias("de"), F.sqrt(F.avg(F.col("fz") * F.col("fz"))).alias("rf"))
    return s.agg(F.round(F.avg(F.abs("de")), 6).alias("mae"), F.round(F.stddev_pop("de"), 6).alias("std_energy"), F.round(F.avg("rf"), 6).alias("mean_force"), F.round(F.stddev_pop("rf"), 6).alias("std_force"))


@query("select calc_uuid, recorded_at, energy is null or aiida_pk is null or (abs(energy) < 60 and abs(aiida_pk % 100) < 50) as kept from dft_runs")
def filter_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dft_runs").select("calc_uuid", "recorded_at", C.within_limits(F.col("energy"), (F.col("aiida_pk") % 100).cast("double"), 60, 50).alias("kept"))


@query("select atl_id, recorded_at, calc_energy from structures order by calc_energy nulls last, atl_id, recorded_at limit 40")
def lowest_energy(spark: SparkSession, d: str) -> DataFrame:
    return K.lowest(table(spark, d, "structures").select("atl_id", "recorded_at", "calc_energy"), "calc_energy", 40, "atl_id", "recorded_at")


@query("select o_orderkey as id from orders order by md5('7:' || o_orderkey), o_orderkey limit 100")
def sample_random(spark: SparkSession, d: str) -> DataFrame:
    return K.sample(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), 100, 7, "id")


@query(f"with {P}, m as (select frame, model, avg(energy) as e, avg(sqrt(fx*fx+fy*fy+fz*fz)) as f from p group by 1, 2), s as (select frame, stddev_pop(e) + 0.1 * stddev_pop(f) as u from m group by frame) select frame, round(u, 6) as u from s order by round(u, 6) desc, frame limit 50")
def most_uncertain(spark: SparkSession, d: str) -> DataFrame:
    m = _preds(spark, d).groupBy("frame", "model").agg(F.avg("energy").alias("e"), F.avg(F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy") + F.col("fz") * F.col("fz"))).alias("f"))
    s = m.groupBy("frame").agg(F.round(F.stddev_pop("e") + 0.1 * F.stddev_pop("f"), 6).alias("u"))
    return s.orderBy(F.desc("u"), "frame").limit(50)


@query("select status, greatest(least(greatest(floor(count(*) * 0.2)::bigint, 5), 40, count(*)), 1)::bigint as size from dft_runs group by status")
def seed_size(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "dft_runs").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return n.select("status", K.seed_size(F.col("n"), 0.2, 5, 40).alias("size"))


_FRAMES = "f as (select user_id as traj, event_id as frame, value, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, count(*) over (partition by user_id) as n from events)"


def _frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    return table(spark, d, "events").select(F.col("user_id").alias("traj"), F.col("event_id").alias("frame"), "value", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("pos"), F.count(F.lit(1)).over(w).alias("n"))


@query(f"with {_FRAMES}, g as (select *, greatest(ceil(n / 6.0)::int, 1) as m from f) select traj, frame from g where list_contains(list_transform(range(m), lambda i: case when m = 1 then 0 else floor(i * (n - 1) / (m - 1)) end::int), pos::int)")
def limit_frames(spark: SparkSession, d: str) -> DataFrame:
    return K.evenly(_frames(spark, d), ["traj"], "pos", "n", F.ceil(F.col("n") / 6.0)).select("traj", "frame")


@query(f"with {_FRAMES} select traj, frame from f where pos % greatest(case when floor(n * 0.1)::int > 0 then floor(n * 0.1)::int else n // 2 end, 1) = 0")
def stride_frames(spark: SparkSession, d: str) -> DataFrame:
    return K.stride(_frames(spark, d), "pos", "n", 0.1).select("traj", "frame")


@query(f"with {_FRAMES} select f.traj, f.frame from f where n <= 10 or list_contains(list_transform(range(10), lambda i: floor(i * n / 10)::int), pos::int)")
def cap_frames(spark: SparkSession, d: str) -> DataFrame:
    return K.capped(_frames(spark, d), "pos", "n", 10).select("traj", "frame")


@query("with r as (select p_brand as phase, p_partkey as id, p_size <= 5 as base, row_number() over (partition by p_brand order by p_size <= 5 desc, md5('3:' || p_partkey), p_partkey) as k from part) select phase, id, base from r where base or k <= 20")
def cap_per_phase(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("phase"), F.col("p_partkey").alias("id"), (F.col("p_size") <= 5).alias("base"))
    return K.cap_per_group(p, ["phase"], 20, "base", 3, "id")


@query("""with s as (select min(p_size) as lo, max(p_size) as hi, least(count(distinct p_size), greatest(1, 60 // 5)) as k from part),
b as (select p_partkey as id, p_size as size, k, case when hi = lo then 0 else least(k - 1, floor((p_size - lo) * k / (hi - lo))) end as b from part, s),
r as (select *, row_number() over (partition by b order by md5('5:' || id), id) > 60 // k + (b < 60 % k)::int as late from b)
select id, size from r order by late, md5('5:' || id), id limit 60""")
def sample_by_size(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return K.by_size(p, "size", 60, 5, "id")


@query("with u as (select o_orderkey as id, ('0x' || substr(md5('9:' || o_orderkey), 1, 8))::bigint / 4294967296.0 as u from orders) select id, case when u < 0.8 then 'train' when u < 0.9 then 'valid' else 'test' end as part from u")
def split_train_valid_test(spark: SparkSession, d: str) -> DataFrame:
    return K.split(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), {"train": 0.8, "valid": 0.1, "test": 0.1}, 9, "id").select("id", "part")


@query("select s_suppkey as id, s_nationkey as grp, ntile(3) over (partition by s_nationkey order by s_suppkey)::int as chunk from supplier")
def chunked(spark: SparkSession, d: str) -> DataFrame:
    return K.chunks(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("grp")), 3, ["grp"], "id")


@query("""with t as (select calc_uuid, queue, lower(status) as status, try_cast(replace(regexp_replace(submitted_at, '(Z|\\+00:00)$', ''), 'T', ' ') as timestamp) as a, try_cast(replace(regexp_replace(finished_at, '(Z|\\+00:00)$', ''), 'T', ' ') as timestamp) as b from dft_runs)
select queue, status, count(*) as n_jobs, round(epoch(max(b) - min(a)), 3) as elapsed_s, round(sum(epoch(b - a)) / 3600, 4) as hours from t group by grouping sets ((queue, status), (queue), ())""")
def performance(spark: SparkSession, d: str) -> DataFrame:
    from latticework.functions.scalar import parse_stamp

    t = table(spark, d, "dft_runs").select("queue", F.lower("status").alias("status"), parse_stamp("submitted_at").alias("a"), parse_stamp("finished_at").alias("b"))
    sec = (F.unix_micros("b") - F.unix_micros("a")) / 1e6
    agg = t.rollup("queue", "status").agg(F.count(F.lit(1)).alias("n_jobs"), F.round((F.unix_micros(F.max("b")) - F.unix_micros(F.min("a"))) / 1e6, 3).alias("elapsed_s"), F.round(F.sum(sec) / 3600, 4).alias("hours"))
    return agg


@query("with t as (select extract(month from ts)::int as step, user_id % 3 as kind, value from events) select step, kind, round(sum(value), 4) as total, round(sum(sum(value)) over (partition by kind order by step), 4) as cumulative from t group by 1, 2")
def cumulative_counters(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").groupBy(F.month("ts").alias("step"), (F.col("user_id") % 3).alias("kind")).agg(F.sum("value").alias("total"))
    return t.select("step", "kind", F.round("total", 4).alias("total"), F.round(F.sum("total").over(Window.partitionBy("kind").orderBy("step")), 4).alias("cumulative"))


@query("select user_id as job, count(*) as total, count(*) filter (where value > 20) as after_filters, count(*) filter (where value > 60) as out, greatest(count(*) filter (where value > 20) - count(*) filter (where value > 60), 0) as in_domain from events group by 1")
def domain_counts(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("job")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") > 20).alias("after_filters"), F.count_if(F.col("value") > 60).alias("out"))
    return g.withColumn("in_domain", F.greatest(F.col("after_filters") - F.col("out"), F.lit(0)))


@query("""with s as (select p_brand as phase, p_size as v, avg(p_retailprice) as e from part group by 1, 2), r as (select phase, max(v) as rv from s group by 1),
d as (select s.phase, s.v, abs(s.e - t.e) as de from s join r on s.phase = r.phase join s t on t.phase = s.phase and t.v = r.rv) select phase, min(v) filter (where de <= 30) as cheapest, round(max(de), 6) as worst, count(*) as n from d group by phase""")
def convergence_sweep(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").groupBy(F.col("p_brand").alias("phase"), F.col("p_size").alias("v")).agg(F.avg("p_retailprice").alias("e"))
    ref = F.max_by("e", "v").over(Window.partitionBy("phase"))
    g = s.withColumn("de", F.abs(F.col("e") - ref)).groupBy("phase")
    return g.agg(F.min(F.when(F.col("de") <= 30, F.col("v"))).alias("cheapest"), F.round(F.max("de"), 6).alias("worst"), F.count(F.lit(1)).alias("n"))


@query("select l_returnflag as grp, l_linestatus as model, round(sum(case when l_linenumber % 2 = 0 then -1 else 1 end * l_quantity), 4) as formation from lineitem group by 1, 2")
def formation_energy(spark: SparkSession, d: str) -> DataFrame:
    f = F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("model")).agg(F.round(F.sum(f * F.col("l_quantity")), 4).alias("formation"))


@query("select p_partkey as id, round((p_retailprice - p_size * 17.5) / (2 * (p_size + 1)) * 16.02176, 5) as j_per_m2 from part")
def surface_energy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round((F.col("p_retailprice") - F.col("p_size") * 17.5) / (2 * (F.col("p_size") + 1)) * 16.02176, 5).alias("j_per_m2"))


@query("select run_id, iteration, max(db_size) as db_size, max(rmse_e) as rmse_e, coalesce(max(rmse_f), 0.0) as rmse_f from al_iterations where db_size is not null and rmse_e is not null group by 1, 2")
def learning_curve(spark: SparkSession, d: str) -> DataFrame:
    it = table(spark, d, "al_iterations").where("db_size is not null and rmse_e is not null")
    return it.groupBy("run_id", "iteration").agg(F.max("db_size").alias("db_size"), F.max("rmse_e").alias("rmse_e"), F.coalesce(F.max("rmse_f"), F.lit(0.0)).alias("rmse_f"))


@query("with r as (select run_id, iteration, max(db_size) as n, max(mae_e) as m from al_iterations group by 1, 2) select run_id, last_value(n) over w as final_size, last_value(n) over w - first_value(n) over w as added from r where n is not null window w as (partition by run_id order by iteration rows between unbounded preceding and unbounded following) qualify row_number() over (partition by run_id order by iteration) = 1")
def final_sizes(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "al_iterations").where("db_size is not null").groupBy("run_id", "iteration").agg(F.max("db_size").alias("n"))
    g = r.groupBy("run_id").agg(F.max_by("n", "iteration").alias("final_size"), F.min_by("n", "iteration").alias("first"))
    return g.select("run_id", "final_size", (F.col("final_size") - F.col("first")).alias("added"))
