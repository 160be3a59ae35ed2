"""Queries of rules on runs, steps, reports, phase diagrams, inversions and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.functions.ids import SQL_KEY, id_key
from latticework.operators import checks, latent, linking, runs
from latticework.session import table

QUERIES, ORACLES = {}, {}
KEY = SQL_KEY.format(c="atl_id")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("select event_type, count(*) as n from events where upper(event_type) in ('ERROR', 'VIEW') group by 1")
def level_filter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(runs.level_allowed(F.col("event_type"), ["error", "view"]))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select run_id, iteration, coalesce(case when iteration % 2 = 0 then iteration end, iteration + 1) as step, count(*) as n from al_iterations group by 1, 2")
def step_numbers(spark: SparkSession, d: str) -> DataFrame:
    it = table(spark, d, "al_iterations")
    given = F.when(F.col("iteration") % 2 == 0, F.col("iteration"))
    return it.groupBy("run_id", "iteration", runs.step_number(given, F.col("iteration")).alias("step")).agg(F.count(F.lit(1)).alias("n"))


@query("select config_snapshot_id as config, count(*) filter (where lower(trim(status)) = 'completed') as n_completed, coalesce(max(case when lower(trim(status)) = 'completed' then id end), 0) as last from al_runs group by 1")
def completed_steps(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "al_runs").withColumn("config", F.col("config_snapshot_id"))
    return runs.completed_steps(r, "config", "id", "status")


@query("select case when lower(trim(status)) in ('finished', 'completed') then 'success' when lower(trim(status)) in ('excepted', 'killed', 'failed') then 'danger' when lower(trim(status)) in ('running', 'waiting', 'created', 'submitted') then 'active' else 'unknown' end as class, count(*) as n from dft_runs group by 1")
def state_classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dft_runs").groupBy(runs.state_class(F.col("status")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("with p as (select p_partkey as id, (case p_size % 4 when 0 then 12 when 1 then 24 when 2 then 28 else 16 end)::int as cores, case when p_size % 5 > 0 then p_size * 3 end as procs from part) select id, case when cores <> 16 then ceil(coalesce(procs, cores) / cores)::int end as nodes, case when cores <> 16 then least(coalesce(procs, cores), cores)::int end as per_node from p")
def scheduler_options(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("p_size") % 4
    cores = F.when(kind == 0, 12).when(kind == 1, 24).when(kind == 2, 28).otherwise(16)
    o = runs.scheduler_options(cores, F.when(F.col("p_size") % 5 > 0, F.col("p_size") * 3))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), o["nodes"].alias("nodes"), o["per_node"].alias("per_node"))


@query(f"with s as (select lower(trim(phase)) as phase, removed_at from structures) select phase, count(*) as before, count(*) filter (where removed_at is null) as after, count(*) filter (where removed_at is null) - count(*) as added from s where phase is not null group by 1")
def step_report(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "structures").select(F.lower(F.trim("phase")).alias("phase"), "removed_at").where("phase is not null")
    return runs.step_report(s, s.where("removed_at is null"), ["phase"])


@query("select length(regexp_replace(formula, '[^A-Z]', '', 'g')) as n_elements, case length(regexp_replace(formula, '[^A-Z]', '', 'g')) when 1 then 'unary' when 2 then 'binary' when 3 then 'ternary' end as kind, count(*) as n from structures where formula is not null and length(regexp_replace(formula, '[^A-Z]', '', 'g')) between 1 and 3 group by 1, 2")
def diagram_kinds(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(F.regexp_replace("formula", "[^A-Z]", ""))
    s = table(spark, d, "structures").where("formula is not null").select(n.cast("long").alias("n_elements")).where("n_elements between 1 and 3")
    return s.groupBy("n_elements", runs.diagram_kind(F.col("n_elements")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("with e as (select formula, list_distinct(regexp_extract_all(formula, '[A-Z][a-z]?')) as els from structures where formula is not null) select formula, count(*) as n from e where len(list_filter(els, lambda x: x not in ('Ni', 'Ti', 'Cu', 'Al'))) > 0 group by 1")
def foreign_elements(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "structures").where("formula is not null")
    els = F.array_distinct(F.regexp_extract_all("formula", F.lit("([A-Z][a-z]?)"), 1))
    return runs.foreign_phases(s, els, ["Ni", "Ti", "Cu", "Al"]).groupBy("formula").agg(F.count(F.lit(1)).alias("n"))


@query("select l_orderkey as target, l_linenumber as start, l_tax as distance, l_discount <= 0.05 as feasible from lineitem qualify row_number() over (partition by l_orderkey order by (l_discount > 0.05), l_tax, l_linenumber, l_partkey) = 1")
def best_starts(spark: SparkSession, d: str) -> DataFrame:
    """Of every target's starts the best: feasible ones first, then the nearest."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_linenumber").alias("start"), F.col("l_tax").alias("distance"), (F.col("l_discount") <= 0.05).alias("feasible"), "l_partkey")
    key = runs.feasible_first(F.col("feasible"), F.col("distance"), F.col("start"), F.col("l_partkey"))
    return runs.best_start(li, ["target"], key).select("target", "start", "distance", "feasible")


@query(f"with l as (select {KEY} as key, unnest(latent_space::double[][]) as p from descriptor_dict where latent_space is not null), m as (select key, avg(p[1]) as x, avg(p[2]) as y from l group by key), t as (select * from (values (0, 0.0, 0.0), (1, 1.0, 0.5), (2, -1.0, 1.0), (3, 99.0, 99.0)) t(target, tx, ty)), d as (select target, key, round(sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)), 9) as d from m, t) select target, key, round(d, 6) as dist from d where d <= 2.0 qualify row_number() over (partition by target order by d, key) = 1")
def nearest_in_view(spark: SparkSession, d: str) -> DataFrame:
    """The nearest point of each view centre, if there is one within the radius."""
    p = table(spark, d, "descriptor_dict").select(id_key("atl_id").alias("key"), F.explode("latent_space").alias("p"))
    m = p.groupBy("key").agg(F.avg(F.col("p")[0].cast("double")).alias("x"), F.avg(F.col("p")[1].cast("double")).alias("y"))
    t = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.5), (2, -1.0, 1.0), (3, 99.0, 99.0)], "target int, tx double, ty double")
    return latent.nearest_within(t, m, "target", "key", 2.0).select("target", "key", F.round("dist", 6).alias("dist"))


@query("with r as (select l_returnflag as model, l_orderkey % 20 * 50 as temperature, avg((l_quantity > 0.05 * (l_orderkey % 20) * 50)::int) as solid from lineitem group by 1, 2), w as (select *, lag(temperature) over (partition by model order by temperature) as t0, lag(solid) over (partition by model order by temperature) as s0 from r) select model, round(min(case when solid <= 0.5 and s0 > 0.5 then t0 + (s0 - 0.5) / (s0 - solid) * (temperature - t0) end), 4) as melting from w group by 1")
def melting_points(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("l_orderkey") % 20 * 50
    r = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), t.alias("temperature")).agg(F.avg((F.col("l_quantity") > 0.05 * t).cast("int")).alias("solid"))
    return runs.melting_point(r, ["model"], "temperature", "solid").select("model", F.round("melting", 4).alias("melting"))


@query("select l_returnflag as model, count(*) as n, round(regr_slope(l_quantity, l_linenumber), 6) as drift, round(stddev_samp(l_quantity), 6) as spread from lineitem group by 1")
def energy_drifts(spark: SparkSession, d: str) -> DataFrame:
    e = runs.energy_drift(table(spark, d, "lineitem").withColumn("model", F.col("l_returnflag")), ["model"], "l_linenumber", "l_quantity")
    return e.select("model", "n", F.round("drift", 6).alias("drift"), F.round("spread", 6).alias("spread"))


@query("select p_partkey as id, round((p_retailprice - (1 + p_size) * 20.5) / pow(1 + p_size, 2 / 3.0::double), 6) as excess from part")
def cluster_energies(spark: SparkSession, d: str) -> DataFrame:
    e = runs.excess_energy(F.col("p_retailprice"), F.col("p_size") + 1, F.lit(20.5))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(e, 6).alias("excess"))


@query("select run_id, iteration as step, round(avg(rmse_e), 6) as rmse_e, round(avg(rmse_f), 6) as rmse_f, count(*) as n from al_iterations where run_id is not null and model_path is not null group by 1, 2")
def test_results(spark: SparkSession, d: str) -> DataFrame:
    it = table(spark, d, "al_iterations").where("run_id is not null and model_path is not null")
    return it.groupBy("run_id", F.col("iteration").alias("step")).agg(F.round(F.avg("rmse_e"), 6).alias("rmse_e"), F.round(F.avg("rmse_f"), 6).alias("rmse_f"), F.count(F.lit(1)).alias("n"))


@query("select r.id as run_id, coalesce(lower(trim(r.status)), 'unknown') as status, count(distinct i.iteration) as steps, max(i.db_size) as largest, round(min(i.rmse_e), 6) as best_e, round(min(i.rmse_f), 6) as best_f, coalesce(min(i.rmse_e) <= 43.0 and min(i.rmse_f) <= 50.0, false) as below_targets from al_runs r left join al_iterations i on i.run_id = r.id group by 1, 2")
def runs_report(spark: SparkSession, d: str) -> DataFrame:
    """One row per run: its steps, the largest training table and the best errors against the targets."""
    r = table(spark, d, "al_runs").select(F.col("id").alias("run_id"), F.coalesce(F.lower(F.trim("status")), F.lit("unknown")).alias("status"))
    it = table(spark, d, "al_iterations").groupBy("run_id").agg(F.countDistinct("iteration").alias("steps"), F.max("db_size").alias("largest"), F.min("rmse_e").alias("e"), F.min("rmse_f").alias("f"))
    both = r.join(it, "run_id", "left")
    met = F.coalesce((F.col("e") <= 43.0) & (F.col("f") <= 50.0), F.lit(False))
    return both.select("run_id", "status", F.coalesce("steps", F.lit(0)).alias("steps"), "largest", F.round("e", 6).alias("best_e"), F.round("f", 6).alias("best_f"), met.alias("below_targets"))


@query("with l as (select {0} as key, latent_space from descriptor_dict), t as (select lower(trim(split_name)) as file, {0} as key from split_members), u as (select distinct file, key from t where key is not null) select u.file, count(distinct u.key) as n, sum(len(l.latent_space))::bigint as points from u join l on u.key = l.key where l.latent_space is not null group by 1".format(KEY))
def latent_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Latent points of several databases put together, each with the name of its own."""
    lat = table(spark, d, "descriptor_dict").where("latent_space is not null").select(id_key("atl_id").alias("key"), F.size("latent_space").alias("points"))
    u = table(spark, d, "split_members").select(F.lower(F.trim("split_name")).alias("file"), id_key("atl_id").alias("key")).where("key is not null").distinct()
    return u.join(lat, "key").groupBy("file").agg(F.countDistinct("key").alias("n"), F.sum("points").alias("points"))


@query("select p_partkey as id, case when p_size % 3 = 0 then p_size * 0.1 when p_size % 3 = 1 then -1.0 end as xx from part")
def stress_of_a_row(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    six = lambda x: F.array_repeat(x, 6)
    first = F.when(size % 3 == 0, six(size * 0.1)).when(size % 3 == 2, F.array(F.lit(0.0)))
    second = F.when(size % 3 == 1, six(F.lit(-1.0)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), runs.stress(first, second)[0].alias("xx"))


@query("select l_orderkey as id, l_linenumber as line, l_quantity as reference, case when l_linenumber % 2 = 0 then l_extendedprice end as model_energy, l_tax as model_force from lineitem")
def model_values_attached(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows with the energy and force of a model; a row that the model failed on stays without."""
    li = table(spark, d, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")))
    key = ["l_orderkey", "l_linenumber", "n"]
    model = li.select(*key, F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")).alias("model_energy"), F.col("l_tax").alias("model_force"))
    out = linking.fill_from(li.withColumn("model_energy", F.lit(None).cast("double")).withColumn("model_force", F.lit(None).cast("double")), model, key, ["model_energy", "model_force"])
    return out.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("reference"), "model_energy", "model_force")


@query("select count(*) as n, sum(part_ = 'test')::bigint as n_test, 'refused' as repeated from (select n_nationkey, case when row_number() over (order by md5('3:' || n_nationkey), n_nationkey) <= greatest(1, floor(25 * 0.2)) then 'test' else 'train' end as part_ from nation)")
def acquisition_databases(spark: SparkSession, d: str) -> DataFrame:
    """Ids are checked before anything else (repeated ones are refused), then the test part is split off."""
    n = table(spark, d, "nation")
    runs.require_ids(n, "n_nationkey")
    try:
        runs.require_ids(n.unionByName(n.where("n_nationkey < 3")), "n_nationkey")
        told = "accepted"
    except ValueError:
        told = "refused"
    s = checks.test_split(n, 0.2, F.lit(False), 3, "n_nationkey")
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("part") == "test").alias("n_test")).withColumn("repeated", F.lit(told))


@query(f"with s as (select distinct {KEY} as key from structures where {KEY} is not null), t as (select distinct {KEY} as key from split_members where lower(trim(split_name)) = 'train' and {KEY} is not null) select count(*) as n_seed, count(*) filter (where s.key in (select key from t)) as n_in_training, count(*) filter (where s.key not in (select key from t)) as n_left from s")
def reduction_databases(spark: SparkSession, d: str) -> DataFrame:
    """The seed of a reduction: all structures but those in training already."""
    s = table(spark, d, "structures").select(id_key("atl_id").alias("key")).where("key is not null").distinct()
    t = table(spark, d, "split_members").where(F.lower(F.trim("split_name")) == "train").select(id_key("atl_id").alias("key")).where("key is not null").distinct()
    left = linking.missing(s, t, ["key"])
    return s.agg(F.count(F.lit(1)).alias("n_seed")).join(left.agg(F.count(F.lit(1)).alias("n_left"))).select("n_seed", (F.col("n_seed") - F.col("n_left")).alias("n_in_training"), "n_left")


@query("select p_partkey as id, round(p_size + 12.0 - 2 * (p_size % 2), 6) as height, p_size % 2 = 1 as changed from part")
def vacuum_adjusted(spark: SparkSession, d: str) -> DataFrame:
    from latticework.operators.builders import adjusted_height

    top = F.col("p_size") - 2.0 * (F.col("p_size") % 2)
    cell = F.col("p_size") + 12.0
    height = adjusted_height(cell, top, F.lit(12.0), 0.5)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(height, 6).alias("height"), (height != cell).alias("changed"))


@query(f"with q as (select distinct {KEY} as key from structures where {KEY} is not null), x as (select distinct {KEY} as key from dft_runs where lower(trim(status)) = 'finished' and {KEY} is not null) select key from q where key not in (select key from x) order by key limit 40")
def next_batch(spark: SparkSession, d: str) -> DataFrame:
    """The next forty structures to label, with sixty places taken of a hundred."""
    q = table(spark, d, "structures").select(id_key("atl_id").alias("key")).where("key is not null")
    done = table(spark, d, "dft_runs").where(F.lower(F.trim("status")) == "finished").select(id_key("atl_id").alias("key")).where("key is not null")
    return runs.next_batch(q, done, "key", [], 60, 100)


@query("select s_suppkey as id, coalesce(case when s_suppkey % 3 > 0 then s_suppkey % 7 end, 0) + 2 <= 6 as has_room from supplier")
def scheduler_room(spark: SparkSession, d: str) -> DataFrame:
    load = F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") % 7)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), runs.has_room(load, F.lit(2), F.lit(6)).alias("has_room"))


@query("select event_id, event_type || '_' || strftime(ts, '%Y%m%dT%H%M%S') || '_' || substr(md5(user_id::varchar || '|' || event_type), 1, 8) as name from events")
def unique_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", runs.unique_name(F.col("event_type"), F.col("ts"), F.col("user_id"), F.col("event_type")).alias("name"))


@query("select p_partkey as id, round(p_retailprice / 27.211386245988, 6) as energy, round(p_size / 27.211386245988, 6) as largest from part")
def calculation_payloads(spark: SparkSession, d: str) -> DataFrame:
    p = runs.payload(F.col("p_retailprice"), F.array(F.lit(0.5), -F.col("p_size").cast("double")), "Ha")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(p["energy"], 6).alias("energy"), F.round(p["largest"], 6).alias("largest"))


@query("select l_orderkey as id, l_linenumber as line, round(sqrt((l_discount - 0.05) * (l_discount - 0.05) + (l_tax - 0.04) * (l_tax - 0.04)), 6) as miss, round(sqrt((l_discount - 0.05) * (l_discount - 0.05) + (l_tax - 0.04) * (l_tax - 0.04)), 9) <= 0.03 as reached from lineitem")
def inversions_annotated(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("tx", F.lit(0.05)).withColumn("ty", F.lit(0.04))
    out = runs.annotated(li, ["tx", "ty"], ["l_discount", "l_tax"], 0.03 + 1e-9)
    return out.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.round("miss", 6).alias("miss"), "reached")


@query("select w.name, (select model_path from al_iterations where regexp_extract(model_path, '[^/]*$') = w.name order by length(model_path), model_path limit 1) as path from (select unnest(['it_01.model', 'it_02.model', 'none.model']) as name) w")
def located_files(spark: SparkSession, d: str) -> DataFrame:
    return runs.located(table(spark, d, "al_iterations").where("model_path is not null"), "model_path", ["it_01.model", "it_02.model", "none.model"])


@query("with c as (select lower(trim(phase)) as phase, count(*) as n from structures where phase is not null group by 1) select phase, n, n * 3 as after_rattle, floor(n * 4.5)::bigint as after_deform, floor(n * 4.5 * 0.8)::bigint as estimate from c")
def dataset_sizes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "structures").where("phase is not null").groupBy(F.lower(F.trim("phase")).alias("phase")).agg(F.count(F.lit(1)).alias("n"))
    return runs.dataset_size(c, "n", {"rattle": 2, "deform": 0.5}, 0.8)
