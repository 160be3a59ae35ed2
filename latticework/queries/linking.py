"""Joins, set operations, ordered computations, walks, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.functions.ids import SQL_KEY, id_key
from latticework.operators import graphs, linking
from latticework.operators import records as R
from latticework.queries.index import SQL_FLAGGED
from latticework.session import table
from latticework.sources import logs

QUERIES, ORACLES = {}, {}
KEY = SQL_KEY.format(c="atl_id")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _ids(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name).select(id_key("atl_id").alias("key"))


@query(SQL_FLAGGED + f"select distinct key from f where not isolated_atom and key is not null and not exists (select 1 from split_members m where {SQL_KEY.format(c='m.atl_id')} = f.key and lower(trim(m.split_name)) = 'train')")
def reduction_seed(spark: SparkSession, d: str) -> DataFrame:
    train = table(spark, d, "split_members").where(F.lower(F.trim("split_name")) == "train").select(id_key("atl_id").alias("key"))
    seed = R.flagged(table(spark, d, "structures")).where("not isolated_atom and key is not null").select("key").distinct()
    return linking.missing(seed, train, ["key"])


@query("""with r as (select atl_id, max(energy) as energy from (select """ + KEY + """ as atl_id, energy from dft_runs where lower(status) = 'finished') where atl_id is not null group by 1),
s as (select """ + KEY + """ as key, recorded_at, calc_energy from structures) select s.key, s.recorded_at, coalesce(r.energy, s.calc_energy) as energy, r.atl_id is not null as matched from s left join r on s.key = r.atl_id""")
def label_merge(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "dft_runs").where(F.lower("status") == "finished").select(id_key("atl_id").alias("key"), "energy").where("key is not null").groupBy("key").agg(F.max("energy").alias("energy"), F.lit(True).alias("matched"))
    s = table(spark, d, "structures").select(id_key("atl_id").alias("key"), "recorded_at", F.col("calc_energy").alias("energy"), F.lit(False).alias("matched"))
    return linking.fill_from(s, done, ["key"], ["energy", "matched"])


@query(f"with r as (select distinct {KEY} as k from dft_runs) select count(*) as n_ids, count(*) filter (where k not in (select {KEY} from structures where {KEY} is not null)) as n_skipped from r where k is not null")
def label_merge_skipped(spark: SparkSession, d: str) -> DataFrame:
    ids = _ids(spark, d, "dft_runs").where("key is not null").distinct()
    there = _ids(spark, d, "structures").distinct().withColumn("there", F.lit(1))
    return ids.join(there, "key", "left").agg(F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("there").isNull()).alias("n_skipped"))


@query(f"with m as (select distinct lower(trim(split_name)) as step, {KEY} as k from split_members), x as (select distinct {KEY} as k from descriptor_dict where latent_space is not null) select step, count(*) as n, min(m.k) as first_id from m join x on m.k = x.k group by step")
def step_mapping(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "split_members").select(F.lower(F.trim("split_name")).alias("step"), id_key("atl_id").alias("key")).distinct()
    x = table(spark, d, "descriptor_dict").where("latent_space is not null").select(id_key("atl_id").alias("key"))
    return m.join(x, "key", "left_semi").groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_id"))


@query("select c_custkey as id, n_name as phase, r_name as material from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def phase_lookup(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    dim = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"], "left")
    c = table(spark, d, "customer")
    return c.join(F.broadcast(dim), c["c_nationkey"] == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("id"), F.col("n_name").alias("phase"), F.col("r_name").alias("material"))


@query("with a as (select run_id, iteration, max(db_size) as db_size from al_iterations where iteration % 3 <> 0 group by 1, 2), b as (select run_id, iteration, max(db_size) + 7 as db_size from al_iterations where iteration % 2 = 0 group by 1, 2), c as (select run_id, iteration, min(db_size) as db_size from al_iterations group by 1, 2), k as (select run_id, iteration from c where run_id is not null and iteration is not null) select k.run_id, k.iteration, coalesce(a.db_size, b.db_size, c.db_size) as db_size from k left join a using (run_id, iteration) left join b using (run_id, iteration) left join c using (run_id, iteration)")
def source_priority(spark: SparkSession, d: str) -> DataFrame:
    it = table(spark, d, "al_iterations").where("run_id is not null and iteration is not null")
    part = lambda df, x: df.groupBy("run_id", "iteration").agg(x.alias("db_size"))
    return linking.in_priority([part(it.where("iteration % 3 <> 0"), F.max("db_size")), part(it.where("iteration % 2 = 0"), F.max("db_size") + 7), part(it, F.min("db_size"))], ["run_id", "iteration"], ["db_size"])


@query("with r as (select calc_uuid, min_by(lower(status), (recorded_at, status)) as a, max_by(lower(status), (recorded_at, status)) as b from dft_runs group by 1) select calc_uuid, a as old, b as new from r where a is distinct from b")
def status_sync(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dft_runs").withColumn("s", F.lower("status")).groupBy("calc_uuid")
    k = F.struct("recorded_at", "status")
    old, new = t.agg(F.min_by("s", k).alias("s")), t.agg(F.max_by("s", k).alias("s"))
    return linking.changed(old, new, ["calc_uuid"], "s")


@query(f"with m as (select {KEY} as k, lower(status) as s from dft_runs) select k, max(s) as status from m where k is not null group by k having bool_or(s = 'running') or not exists (select 1 from descriptor_dict x where {SQL_KEY.format(c='x.atl_id')} = k)")
def missing_cache(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "dft_runs").select(id_key("atl_id").alias("key"), F.lower("status").alias("s")).where("key is not null").groupBy("key").agg(F.max("s").alias("status"), F.max(F.col("s") == "running").alias("running"))
    cached = _ids(spark, d, "descriptor_dict").where("key is not null").distinct().withColumn("cached", F.lit(True))
    return m.join(cached, "key", "left").where(F.col("running") | F.col("cached").isNull()).select(F.col("key").alias("k"), "status")


@query(f"select 'structures' as side, {KEY} as k from structures where {KEY} is not null union all select 'new', k from (select distinct {KEY} as k from descriptor_dict) where k is not null and k not in (select {KEY} from structures where {KEY} is not null)")
def insert_missing(spark: SparkSession, d: str) -> DataFrame:
    s = _ids(spark, d, "structures").where("key is not null")
    new = linking.missing(_ids(spark, d, "descriptor_dict").where("key is not null").distinct(), s, ["key"])
    return s.select(F.lit("structures").alias("side"), F.col("key").alias("k")).unionByName(new.select(F.lit("new").alias("side"), F.col("key").alias("k")))


@query("select user_id, event_id from events where value > 90 union select user_id, event_id from events where event_type = (select min(event_type) from events) and value > 50")
def out_of_domain_union(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type").alias("f"))
    b = e.join(F.broadcast(first)).where((F.col("event_type") == F.col("f")) & (F.col("value") > 50))
    return e.where("value > 90").select("user_id", "event_id").union(b.select("user_id", "event_id")).distinct()


@query("select event_id from events except select event_id from events where value > 75 except select event_id from events where value < 5")
def frames_after_filters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "value")
    hits = e.where("value > 75").select("event_id").union(e.where("value < 5").select("event_id"))
    return linking.missing(e.select("event_id").distinct(), hits, ["event_id"])


@query("select o_orderkey as id, 15000 + 2 * (row_number() over (partition by o_custkey order by o_orderkey) - 1) + 1 as db_index, o_custkey as step from orders where o_orderstatus = 'F'")
def append_results(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return o.select(F.col("o_orderkey").alias("id"), (15000 + 2 * nth + 1).cast("long").alias("db_index"), F.col("o_custkey").alias("step"))


# ordered computations


@query("with r as (select run_id, iteration, max(db_size) as n from al_iterations where run_id is not null group by 1, 2) select run_id, iteration, coalesce(n - lag(n) over w, 0) as delta, n - first_value(n) over w as grown, case when first_value(n) over w > 0 then round(n / first_value(n) over w::double, 6) end as ratio from r window w as (partition by run_id order by iteration)")
def growth(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "al_iterations").where("run_id is not null").groupBy("run_id", "iteration").agg(F.max("db_size").alias("n"))
    w = Window.partitionBy("run_id").orderBy("iteration")
    first = F.first("n").over(w)
    return r.select("run_id", "iteration", F.coalesce(F.col("n") - F.lag("n").over(w), F.lit(0)).alias("delta"), (F.col("n") - first).alias("grown"), F.when(first > 0, F.round(F.col("n") / first, 6)).alias("ratio"))


@query("with g as (select l_orderkey as id, l_quantity as z from lineitem), w as (select id, z, z - lag(z) over (partition by id order by z) as gap from g) select id, max(z) - min(z) as thickness, max(gap) as max_gap, count(gap) >= 2 and max(gap) - min(gap) <= 0.001 as equal_layers from w group by id")
def layer_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("z"))
    w = g.withColumn("gap", F.col("z") - F.lag("z").over(Window.partitionBy("id").orderBy("z")))
    return w.groupBy("id").agg((F.max("z") - F.min("z")).alias("thickness"), F.max("gap").alias("max_gap"), ((F.count("gap") >= 2) & (F.max("gap") - F.min("gap") <= 0.001)).alias("equal_layers"))


@query("with p as (select user_id as path, event_id as id, value as x, lag(value) over w as px, row_number() over w as k from events window w as (partition by user_id order by ts, event_id)), c as (select *, sum(coalesce(abs(x - px), 0)) over (partition by path order by k) as s from p) select path, id, round(s, 6) as arc, round(s / nullif(max(s) over (partition by path), 0), 9) as part from c")
def arc_length(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("id"), F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)), F.lit(0.0)).alias("step"), F.row_number().over(w).alias("k"))
    s = e.withColumn("s", F.sum("step").over(Window.partitionBy("path").orderBy("k")))
    total = F.nullif(F.max("s").over(Window.partitionBy("path")), F.lit(0.0))
    return s.select("path", "id", F.round("s", 6).alias("arc"), F.round(F.col("s") / total, 9).alias("part"))


@query("select p_brand as grp, p_partkey as id, (row_number() over w)::int as rank, round((count(*) over (partition by p_brand) - row_number() over w) / count(*) over (partition by p_brand)::double, 6) as score from part window w as (partition by p_brand order by p_retailprice desc, p_partkey)")
def rank_scores(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand")
    r = F.row_number().over(w.orderBy(F.desc("p_retailprice"), "p_partkey"))
    n = F.count(F.lit(1)).over(w)
    return table(spark, d, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), r.alias("rank"), F.round((n - r) / n, 6).alias("score"))


@query("select run_id, iteration, round(5.0 + 45.0 * pow(0.8, iteration), 6) as rmse, round(100 + (iteration - 1) * 20.0::double, 6) as temperature from (select distinct run_id, iteration from al_iterations where run_id is not null)")
def mock_decay(spark: SparkSession, d: str) -> DataFrame:
    from latticework.functions.scalar import decay

    it = table(spark, d, "al_iterations").where("run_id is not null").select("run_id", "iteration").distinct()
    return it.select("run_id", "iteration", F.round(decay(F.col("iteration"), 50.0, 5.0, 0.8), 6).alias("rmse"), F.round(100 + (F.col("iteration") - 1) * 20.0, 6).alias("temperature"))


# walks: the process tree of orders, in which node k was called by (k - 1) div 3


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), "o_orderstatus")
    return o, o.where("node > 0").select(((F.col("node") - 1) / 3).cast("long").alias("parent"), F.col("node").alias("child"))


_TREE = "with recursive e as (select (o_orderkey - 1) // 3 as parent, o_orderkey as child from orders where o_orderkey > 0), "


@query(_TREE + "t as (select o_orderkey as root, o_orderkey as node, 0 as depth from orders where o_orderkey in (1, 2, 5) union all select t.root, e.child, t.depth + 1 from t join e on e.parent = t.node) select root, node, depth from t where depth > 0")
def process_descendants(spark: SparkSession, d: str) -> DataFrame:
    o, e = _tree(spark, d)
    return graphs.descendants(e, o.where("node in (1, 2, 5)"))


@query(_TREE + "t as (select o_orderkey as root, o_orderkey as node, 0 as depth from orders where o_orderkey in (1, 2, 5) union all select t.root, e.child, t.depth + 1 from t join e on e.parent = t.node) select root, count(*) filter (where o_orderstatus = 'F') as n_finished, count(*) as n_jobs, max(depth)::int as deepest from t join orders on node = o_orderkey where depth > 0 group by root")
def process_job_counts(spark: SparkSession, d: str) -> DataFrame:
    o, e = _tree(spark, d)
    t = graphs.descendants(e, o.where("node in (1, 2, 5)")).join(o, "node")
    return t.groupBy("root").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"), F.count(F.lit(1)).alias("n_jobs"), F.max("depth").alias("deepest"))


@query(_TREE + "x as (select parent, child from e where parent not in (0, 4, 7)), t as (select o_orderkey as node, o_orderkey as top from orders where o_orderkey not in (select child from x) union all select x.child, t.top from t join x on x.parent = t.node) select node, top as root from t")
def process_roots(spark: SparkSession, d: str) -> DataFrame:
    o, e = _tree(spark, d)
    return graphs.root_of(e.where("parent not in (0, 4, 7)"), o.select("node"))


@query(_TREE + "x as (select parent, child from e where parent not in (0, 4, 7)), t as (select o_orderkey as node, o_orderkey as top from orders where o_orderkey not in (select child from x) union all select x.child, t.top from t join x on x.parent = t.node) select node, min(node) over (partition by top) as component from t")
def bond_components(spark: SparkSession, d: str) -> DataFrame:
    o, e = _tree(spark, d)
    return graphs.components(e.where("parent not in (0, 4, 7)").select(F.col("parent").alias("a"), F.col("child").alias("b")), o.select("node"))


# logs: the iterations of the index written out as log lines and read back


def _log(spark: SparkSession, d: str) -> DataFrame:
    it = table(spark, d, "al_iterations").where("run_id is not null and db_size is not null and rmse_e is not null and rmse_f is not null").groupBy("run_id", "iteration").agg(F.max("db_size").alias("n"), F.max("rmse_e").alias("e"), F.max("rmse_f").alias("f"))
    i, n = F.col("iteration"), F.col("n")
    lines = F.array(
        F.format_string("2025-01-01 INFO Starting AL Loop iteration %d/%d...", i, F.lit(99)),
        F.format_string("Iteration %d: seed_gen_db %d, training_db: %d entries", i, n * 2, n),
        F.format_string("Extrapolation statistics (AL step %d): %d interpolating (x), %d extrapolating (y), %d out-of-domain (union), %d in-domain, %d after filters / %d total frames. Submitted to DFT: %d, skipped 0", i, n % 7, n % 5, n % 11, n % 13, n % 17, n, n % 3),
        F.format_string("Best model of current step is 2: RMSE E: %.2f meV/at, RMSE F: %.2f meV/Å", F.col("e"), F.col("f")),
    )
    return it.select("run_id", F.posexplode(lines).alias("p", "line"), (i * 10).alias("base")).select("run_id", (F.col("base") + F.col("p")).alias("pos"), "line")


@query("with t as (select run_id, iteration as step, max(db_size) as n, max(rmse_e) as e, max(rmse_f) as f from al_iterations where run_id is not null and db_size is not null and rmse_e is not null and rmse_f is not null group by 1, 2) select run_id, step, 99::bigint as planned, n * 2 as seed_size, n as training_size, n % 7 as interpolating, n % 5 as extrapolating, n % 11 as out_of_domain, n % 13 as in_domain, n % 17 as after_filters, n as frames, n % 3 as submitted from t")
def log_iterations(spark: SparkSession, d: str) -> DataFrame:
    return logs.iterations(_log(spark, d), ["run_id"]).drop("rmse_e", "rmse_f")


@query("select calc_uuid, recorded_at, aiida_pk as pk from dft_runs")
def log_submitted_pk(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "dft_runs")
    line = F.when(F.col("aiida_pk") % 2 == 0, F.format_string("submitted WorkChain<%d>", "aiida_pk")).otherwise(F.format_string("launched, PK: %d", "aiida_pk"))
    return r.select("calc_uuid", "recorded_at", logs.submitted_pk(line).alias("pk"))
