"""Queries of chains: generation of a database, maps of descriptors, the loop on plug-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.functions import seeded
from latticework.operators import checks as C
from latticework.operators import graphs
from latticework.plans import generation, loop, maps
from latticework.queries.atoms import PAIRS, T, _a, _radius
from latticework.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"with {T}, r2 as (select unnest([0, 1]) as k) select id, (idx * 8 + (a.k * 2 + b.k) * 2 + c.k)::int as idx, element, round(x + a.k * 6.0, 6) as x, round(y + b.k * 6.0, 6) as y, round(z + c.k * 6.0, 6) as z from a as s, r2 a, r2 b, r2 c".replace("from a as s", "from (select * from a) s"))
def expanded_cells(spark: SparkSession, d: str) -> DataFrame:
    e = generation.expanded(_a(spark, d), 2, F.lit(6.0))
    return e.select("id", F.col("idx").cast("int").alias("idx"), "element", *[F.round(c, 6).alias(c) for c in "xyz"])


_LEFT = f"n as (select *, count(*) over (partition by id) as n, row_number() over (partition by id order by {seeded.sql_uniform('6v', 'id', 'idx')}, idx) as k from r), r2 as (select * from n where k > least(floor(n * (0.1 + 0.3 * {seeded.sql_uniform(6, 'id')})), n - 1))"


@query(f"with recursive {T}, {_LEFT}, {PAIRS.replace('from r u join r v', 'from r2 u join r2 v')}, e as (select id, i, j from p where dist <= 1.1 * rr), w as (select id, idx as node, idx as top from r2 union select w.id, e.j, w.top from w join e on e.id = w.id and e.i = w.node), c as (select id, node, min(top) as c from w group by 1, 2), s as (select id, c, count(*) as m from c group by 1, 2), g as (select id from s group by id having max(m) / sum(m) >= 0.5) select id, idx, element from r2 where id in (select id from g)")
def whole_vacancies(spark: SparkSession, d: str) -> DataFrame:
    """Vacancies without the structures whose largest fragment is below a half."""
    return generation.vacancies(_a(spark, d), _radius(), 0.1, 0.4, 6, 0.5).select("id", "idx", "element")


@query(f"with {T}, m as (select id, avg(x) as mx, avg(y) as my, avg(z) as mz from a group by id), k as (select a.id, a.idx, a.element, round((x - mx) / 0.001)::bigint as kx, round((y - my) / 0.001)::bigint as ky, round((z - mz) / 0.001)::bigint as kz, round((mx - x) / 0.001)::bigint as ix, round((my - y) / 0.001)::bigint as iy, round((mz - z) / 0.001)::bigint as iz from a join m on a.id = m.id) select id, idx, exists (select 1 from k o where o.id = k.id and o.element = k.element and o.ix = k.kx and o.iy = k.ky and o.iz = k.kz) as paired from k")
def symmetrical_atoms(spark: SparkSession, d: str) -> DataFrame:
    return generation.symmetrical(_a(spark, d))


@query(f"with {T}, p as (select id, 'phase' || (id % 5)::varchar as phase, count(*) as n from a group by 1, 2), b as (select phase, count(*) * 2 as n from p where n * 8 <= 40 group by 1) select stage, phase, case when stage in ('limit', 'adsorbates') then least(n, 300) else n end as n from b, (select unnest(['bulk', 'vacancies', 'limit', 'adsorbates']) as stage)")
def generation_stages(spark: SparkSession, d: str) -> DataFrame:
    """The structures of each phase after each stage: supercells up to 40 atoms in two rattled copies, vacancies, a limit, adsorbates."""
    a = _a(spark, d).withColumn("phase", F.concat(F.lit("phase"), (F.col("id") % 5).cast("string")))
    s = generation.Settings(repeats=2, most_atoms=40, replace=("Ni", "Cu", 2), rattle=0.02, copies=2, vacancies=(0.05, 0.2), whole=None, per_phase=300, adsorbate=("O", 1.8, 1.5), seed=3)
    return generation.generate(a, F.lit(6.0), F.when(F.col("element") == "Ti", 1.6).otherwise(1.24), s)[1]


@query("select p_partkey as id, (p_size + 12)::bigint as n, 2.55::double as nearest from part")
def wulff_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of a Wulff shape: their atoms and the distance of nearest neighbours."""
    req = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("Cu").alias("element"), (F.col("p_size") + 12).alias("n"))
    at = C.cluster_arrays(req, 2.55, "wulff")  # a cluster is one row: nothing is shuffled
    d = F.transform(F.arrays_zip("x", "y", "z"), lambda p, i: F.when(i > 0, F.sqrt(sum((p[c] - F.col(c)[0]) * (p[c] - F.col(c)[0]) for c in "xyz"))))
    return at.select("id", F.size("x").cast("long").alias("n"), F.round(F.array_min(d), 6).alias("nearest"))


def _map(spark: SparkSession, d: str) -> tuple[DataFrame, maps.Axes, list]:
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    return maps.build(e, "v", 64)


@query("select label, count(*) as n, true as outside_fits from embeddings group by 1")
def map_evolution(spark: SparkSession, d: str) -> DataFrame:
    """A map by two principal axes, its boundary, and how many points of each label lie outside it."""
    rows, _, ring = _map(spark, d)
    e = maps.evolution(rows, "label", ring)
    return e.select("label", "n", (F.col("outside") <= F.col("n")).alias("outside_fits"))


@query("select count(*) as n, 0.0::double as mean_x, 0.0::double as mean_y, 0.0::double as together, true as first_is_larger from embeddings")
def map_rules(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates on principal axes have zero means and do not vary together."""
    rows, a, _ = _map(spark, d)
    zero = lambda c: F.round(F.abs(c), 6)
    return rows.agg(F.count(F.lit(1)).alias("n"), zero(F.avg("x")).alias("mean_x"), zero(F.avg("y")).alias("mean_y"), zero(F.covar_pop("x", "y")).alias("together"), (F.var_pop("x") >= F.var_pop("y")).alias("first_is_larger"))


@query("with p as (select count(*) as n from part), s as (select unnest(range(1, 4)) as step) select step, 100 + (step - 1) * least(500, floor((n - 100) * 0.2))::bigint as n_training, n - 100 as n_seed, least(500, floor((n - 100) * 0.2))::bigint as n_frames, least(500, floor((n - 100) * 0.2))::bigint as n_selected, 'the most steps were made' as why from p, s")
def loop_history(spark: SparkSession, d: str) -> DataFrame:
    """Three steps of the loop with models that never agree: what each step had and chose, and why it ended."""
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), "p_size", F.row_number().over(Window.orderBy("p_partkey")).alias("nth"))
    simulate = lambda df: df.withColumn("frame", F.lit(0))
    predict = lambda fr: fr.withColumn("model", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("energy", F.col("model") * 400.0)
    run = loop.Loop(simulate, predict, lambda fr: fr.select("key", "p_size", "nth"), lambda step, t: [("m1", 90.0 / step, 60.0), ("m2", 95.0, None)], most_steps=3)
    run.run(rows.where("nth <= 100"), rows)
    return spark.createDataFrame([(s.number, s.n_training, s.n_seed, s.n_frames, s.n_selected, run.why) for s in run.history], "step long, n_training long, n_seed long, n_frames long, n_selected long, why string")


@query("select * from (values ('agree', 'the models agree', 25::bigint), ('dead', 'no model could be trained', 25), ('empty', 'the seed table is exhausted', 25)) t(case_, why, n_training)")
def loop_ends(spark: SparkSession, d: str) -> DataFrame:
    """The ends of the loop: agreement, no trained model, an exhausted seed."""
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), "p_partkey")
    start = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.col("n_nationkey").cast("long").alias("p_partkey"))
    simulate = lambda df: df.withColumn("frame", F.lit(0))
    same = lambda fr: fr.select("key", "frame", F.lit("m").alias("model"), F.lit(0.0).alias("energy"))
    out = []
    for name, seed, error in (("agree", rows, 1.0), ("dead", rows, None), ("empty", start, 1.0)):
        run = loop.Loop(simulate, same, lambda fr: fr, lambda step, t, error=error: [("m", error, error)])
        n = run.run(start, seed).count()
        out.append((name, run.why, n))
    return spark.createDataFrame(out, "case_ string, why string, n_training long")


@query("with recursive e as (select n_nationkey as node, (n_nationkey * n_nationkey + 3) % 25 as other from nation), b as (select node as a, other as b from e union select other, node from e), w as (select n_nationkey as node, n_nationkey as top from nation union select b.b, w.top from w join b on b.a = w.node) select node, min(top) as component from w group by node")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of a graph with cycles."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    return graphs.components(n.select(F.col("node").alias("a"), ((F.col("node") * F.col("node") + 3) % 25).alias("b")), n)
