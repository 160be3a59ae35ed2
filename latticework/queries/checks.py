"""Queries of the filters that need atoms or trajectories, of strategies and of splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import seeded
from latticework.operators import atoms as A
from latticework.operators import checks as C
from latticework.operators import records as R
from latticework.queries.atoms import COORD, PAIRS, T, _a, _radius
from latticework.queries.index import SQL_FLAGGED
from latticework.queries.vectors import sql_farthest
from latticework.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"with {T}, g as (select id, z - lag(z) over (partition by id order by z) as gap, z from a), l as (select id, max(z) - min(z) as thickness, max(gap) filter (where gap > 0.001) as hi, count(gap) filter (where gap > 0.001) as n, min(gap) filter (where gap > 0.001) as lo from g group by id) select id, coalesce(hi > 2.0, false) as layer_distance, thickness > 3.25 as evaporation, coalesce(n >= 2 and abs(hi - lo) <= 0.2 + 1e-5 * abs(lo), false) as duplicate_slabs from l")
def layer_filters(spark: SparkSession, d: str) -> DataFrame:
    out = C.layer_filters(C.layers(_a(spark, d)), 2.0, 3.25, 0.2)
    return out.withColumn("duplicate_slabs", F.coalesce("duplicate_slabs", F.lit(False)))


_FRAG = f"""with recursive {T}, {PAIRS}, e as (select id, i, j from p where dist <= 1.1 * rr), w as (select id, idx as node, idx as top from a union select w.id, e.j, w.top from w join e on e.id = w.id and e.i = w.node),
c as (select id, node, min(top) as c from w group by 1, 2), s as (select id, c, count(*) as n from c group by 1, 2)
"""


@query(_FRAG + "select id, count(*) as n_fragments, round(max(n) / sum(n), 6) as largest_fraction, max(n) / sum(n) < 0.95 as fragmented from s group by id")
def fragments(spark: SparkSession, d: str) -> DataFrame:
    per = C.fragments(_a(spark, d), _radius())
    return per.select("id", "n_fragments", F.round("largest_fraction", 6).alias("largest_fraction"), (F.col("largest_fraction") < 0.95).alias("fragmented"))


@query(f"with {T}, {PAIRS}, {COORD}, m as (select id, min(dist / rr) as ratio from p where i < j group by id) select c.id, coalesce(bool_and(m.ratio >= 0.7), true) as far_enough, sum(coord)::bigint as bonds from c left join m on c.id = m.id group by c.id")
def physical(spark: SparkSession, d: str) -> DataFrame:
    a = _a(spark, d)
    near = A.closest_pair(a, _radius()).select("id", (F.col("ratio") >= 0.7).alias("ok"))
    n = A.coordination(a, _radius(), 1.1).groupBy("id").agg(F.sum("coord").alias("bonds"))
    return n.join(near, "id", "left").select("id", F.coalesce("ok", F.lit(True)).alias("far_enough"), "bonds")


@query(f"with {T}, {PAIRS}, {COORD} select distinct p.id from p join c u on u.id = p.id and u.idx = p.i join c v on v.id = p.id and v.idx = p.j where dist <= 1.1 * rr and u.coord < 3 and v.coord < u.coord")
def loose_bonds(spark: SparkSession, d: str) -> DataFrame:
    a = _a(spark, d)
    bonds = A.pairs(a, _radius()).where(F.col("dist") <= 1.1 * (F.col("ri") + F.col("rj")))
    return C.loose_bonds(A.coordination(a, _radius(), 1.1), bonds)


@query("with f as (select l_orderkey as id, sum(l_extendedprice) - 300000 as e, max(l_quantity) as t, max(l_discount) as f, max(l_tax) as v from lineitem group by 1) select id, case when e > 0 then 'energy' when t > 4.9 * 10 then 'temperature' when f > 0.095 then 'force' when v > 0.075 then 'velocity' end as sign from f")
def explosion_signs(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.sum("l_extendedprice") - 300000).alias("e"), F.max("l_quantity").alias("t"), F.max("l_discount").alias("f"), F.max("l_tax").alias("v"))
    one = lambda c: F.array(F.col(c))
    return g.select("id", C.exploding(F.col("e"), one("t"), one("f"), one("v"), most_t=4.9, most_f=0.095, most_v=0.075, positive_energy=True).alias("sign"))


@query("select p_partkey as id, least(p_size, p_retailprice / 100, 12) < 9.5 as short from part")
def short_cells(spark: SparkSession, d: str) -> DataFrame:
    lengths = F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100, F.lit(12.0))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.short_cell(lengths, 9.5).alias("short"))


@query("select distinct run_id, iteration, iteration in (1, 2, 3, 5) as by_step from al_iterations where run_id is not null")
def stages(spark: SparkSession, d: str) -> DataFrame:
    it = table(spark, d, "al_iterations").where("run_id is not null").select("run_id", "iteration").distinct()
    return it.select("run_id", "iteration", C.stage_allowed("1-3, 5", F.col("iteration"), F.lit("bulk"), ["bulk"]).alias("by_step"))


@query(SQL_FLAGGED + "select distinct phase from f where phase is not null and phase not in ('alpha', 'beta')")
def phases_without_setting(spark: SparkSession, d: str) -> DataFrame:
    p = R.flagged(table(spark, d, "structures")).where("phase is not null").select("phase").distinct()
    return C.without_setting(p, {"alpha": 0.2, "beta": 0.3})


@query(SQL_FLAGGED + ", k as (select distinct key, isolated_atom from f where key is not null), n as (select count(*) as n from k), r as (select *, row_number() over (order by md5('2:' || key || ':' || isolated_atom), key, isolated_atom) as i from k) select key, case when i <= greatest(1, floor(n * 0.1)) and isolated_atom then 'neither' when i <= greatest(1, floor(n * 0.1)) then 'test' else 'train' end as part, isolated_atom from r, n")
def test_split(spark: SparkSession, d: str) -> DataFrame:
    k = R.flagged(table(spark, d, "structures")).where("key is not null").select("key", "isolated_atom").distinct()
    return C.test_split(k, 0.1, F.col("isolated_atom"), 2, "key", "isolated_atom").select("key", "part", "isolated_atom")


@query("select vec_id from embeddings order by md5('3:' || vec_id), vec_id limit 25")
def strategy_random(spark: SparkSession, d: str) -> DataFrame:
    return C.select(table(spark, d, "embeddings").select("vec_id"), "random", 25, seed=3, ident="vec_id")


@query("select calc_uuid, recorded_at, energy from dft_runs order by energy nulls last, calc_uuid, recorded_at limit 30")
def strategy_lowest(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "dft_runs").select("calc_uuid", "recorded_at", "energy")
    return runs.orderBy(F.asc_nulls_last("energy"), "calc_uuid", "recorded_at").limit(30)


@query(f"select vec_id from ({sql_farthest(8, '0, 1')})")
def strategy_fps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    first = [r["v"] for r in e.where("vec_id in (0, 1)").collect()]
    return C.select(e, "fps", 8, ident="vec_id", vector="v", start=first).select("vec_id")


@query("with s as (select 'encut' as param, unnest([300.0, 500.0, 400.0]) as value union all select 'kspacing', unnest([0.2, 0.4, 0.3])) select param, value::double as value, row_number() over (partition by param order by case when param = 'kspacing' then -value else value end)::int as rank from s")
def cheap_first(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    s = spark.createDataFrame([("encut", 300.0), ("encut", 500.0), ("encut", 400.0), ("kspacing", 0.2), ("kspacing", 0.4), ("kspacing", 0.3)], "param string, value double")
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("param").orderBy(C.cheap_rank(F.col("param"), F.col("value")))))


@query("select n_nationkey as path, k, round(n_regionkey + 3.0 * least(k * 7.0 / 6, 3.0) / 3.0, 6) as x, round(greatest(k * 7.0 / 6 - 3.0, 0.0), 6) as y from nation, (select unnest(range(7)) as k)")
def path_samples(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("path"), F.col("n_regionkey").cast("double").alias("r"))
    corner = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("y")) for i, dx, dy in ((0, 0.0, 0.0), (1, 3.0, 0.0), (2, 3.0, 4.0))])
    p = n.select("path", "r", F.explode(corner).alias("c")).select("path", "c.i", (F.col("r") + F.col("c.dx")).alias("x"), "c.y")
    out = C.resample(p, 7, ["path"], ["i"], "x", "y")
    return out.select("path", F.col("k").cast("long").alias("k"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"with {T}, h as (select *, max(z) over (partition by id) as zmax, max(idx) over (partition by id) as last from a), s as (select *, row_number() over (partition by id order by {seeded.sql_uniform(9, 'id', 'idx')}, idx) as n from h where z >= zmax - 0.1 or not exists (select 1 from a o where o.id = h.id and o.z > h.z + 0.1 and sqrt((o.x-h.x)*(o.x-h.x) + (o.y-h.y)*(o.y-h.y)) < 1.5)) select id, idx::int as idx, element, round(z, 6) as z from a union all select id, (last + 1)::int, 'O', round(z + 1.8, 6) from s where n = 1")
def adsorbates(spark: SparkSession, d: str) -> DataFrame:
    a = _a(spark, d)
    out = C.with_adsorbate(a, A.exposed(a, 1.5), "O", 1.8, 9)
    return out.select("id", F.col("idx").cast("int").alias("idx"), "element", F.round("z", 6).alias("z"))


@query()
def cluster_atoms(spark: SparkSession, d: str) -> DataFrame:
    req = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("Cu").alias("element"), (F.col("p_size") + 12).alias("n"))
    return C.clusters(spark, req, 2.55)


@query("select p_partkey as id, (p_size + 12)::bigint as n from part")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return cluster_atoms(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("with m as (select distinct run_id, iteration from al_iterations where run_id is not null), x as (select run_id, iteration, unnest([0, 1, 2]) as model from m) select run_id, iteration, model, round((5.0 + 45.0 * pow(0.8, iteration)) * (0.9 + 0.2 * " + seeded.sql_uniform(4, "run_id", "iteration", "model") + "), 6) as rmse from x")
def mock_committee(spark: SparkSession, d: str) -> DataFrame:
    from latticework.functions.scalar import decay

    m = table(spark, d, "al_iterations").where("run_id is not null").select("run_id", "iteration").distinct().withColumn("model", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return m.select("run_id", "iteration", "model", F.round(decay(F.col("iteration"), 50.0, 5.0, 0.8) * (0.9 + 0.2 * seeded.uniform(4, "run_id", "iteration", "model")), 6).alias("rmse"))


@query("select 'finished' as which, count(*) as n from dft_runs where lower(status) = 'finished'")
def gather_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "dft_runs")
    done = C.or_else(runs.where(F.lower("status") == "no such state"), runs.where(F.lower("status") == "finished"))
    return done.agg(F.count(F.lit(1)).alias("n")).select(F.lit("finished").alias("which"), "n")
