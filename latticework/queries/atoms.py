"""Queries on atom rows: checks and generators. lineitem plays the atoms: order = structure, line = atom."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import seeded
from latticework.operators import atoms as A
from latticework.operators import repeats
from latticework.operators.records import keep_first
from latticework.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


T = "a as (select l_orderkey as id, l_linenumber as idx, case when l_returnflag = 'N' then 'Ni' else 'Ti' end as element, l_quantity / 10 as x, l_discount * 40 as y, l_tax * 50 as z from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1), r as (select *, case when element = 'Ni' then 1.24 else 1.6 end as rad, case when element = 'Ni' then 58.693 else 47.867 end as mass from a)"
PAIRS = "p as (select u.id, u.idx as i, v.idx as j, sqrt((u.x-v.x)*(u.x-v.x) + (u.y-v.y)*(u.y-v.y) + (u.z-v.z)*(u.z-v.z)) as dist, u.rad + v.rad as rr from r u join r v on u.id = v.id and u.idx <> v.idx)"
COORD = "c as (select r.id, r.idx, count(p.j) as coord from r left join p on p.id = r.id and p.i = r.idx and p.dist <= 1.1 * rr group by 1, 2)"


def _a(spark: SparkSession, d: str) -> DataFrame:
    li = keep_first(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("idx"), F.when(F.col("l_returnflag") == "N", "Ni").otherwise("Ti").alias("element"), (F.col("l_quantity") / 10).alias("x"), (F.col("l_discount") * 40).alias("y"), (F.col("l_tax") * 50).alias("z"))


def _radius():
    return F.when(F.col("element") == "Ni", 1.24).otherwise(1.6)


@query(f"with {T}, {PAIRS}, {COORD} select id, idx, coord from c")
def coordination(spark: SparkSession, d: str) -> DataFrame:
    return A.coordination(_a(spark, d), _radius(), 1.1)


@query(f"with {T}, {PAIRS}, {COORD} select id, min(coord) <= 0 as no_neighbors, avg(case when coord <= 3 then 1.0 else 0.0 end) > 0.5 as low_coordination from c group by id")
def neighbour_filters(spark: SparkSession, d: str) -> DataFrame:
    return A.neighbour_filters(_a(spark, d), _radius(), 1.1)


@query(f"with {T}, {PAIRS}, q as (select id, round(dist / rr, 6) as ratio from p where i < j) select id, min(ratio) as ratio from q group by id")
def closest_pair(spark: SparkSession, d: str) -> DataFrame:
    return A.closest_pair(_a(spark, d), _radius()).select("id", F.round("ratio", 6).alias("ratio"))


@query(f"with {T}, {PAIRS} select id, min(dist / rr) < 0.7 as outlier from p where i < j group by id")
def bond_outliers(spark: SparkSession, d: str) -> DataFrame:
    return A.closest_pair(_a(spark, d), _radius()).select("id", (F.col("ratio") < 0.7).alias("outlier"))


@query(f"with {T}, {PAIRS} select r.id, bool_or(coalesce(e.m, 0) > 0) as exploded from (select distinct id from r) r left join (select id, max((dist > 5.0 or dist < 0.8)::int) as m from p group by id) e on r.id = e.id group by r.id")
def exploding(spark: SparkSession, d: str) -> DataFrame:
    a = _a(spark, d)
    bad = A.pairs(a).groupBy("id").agg(F.max((F.col("dist") > 5.0) | (F.col("dist") < 0.8)).alias("e"))
    return a.select("id").distinct().join(bad, "id", "left").select("id", F.coalesce("e", F.lit(False)).alias("exploded"))


@query(f"with {T}, {PAIRS}, e as (select id, sum(4 * (pow(2.2 / dist, 12) - pow(2.2 / dist, 6))) as e from p where i < j and dist > 1.5 group by id) select i.id, round(coalesce(e, 0), 4) as energy from (select distinct id from a) i left join e on i.id = e.id")
def pair_energy(spark: SparkSession, d: str) -> DataFrame:
    a = _a(spark, d)
    s6 = F.pow(F.lit(2.2) / F.col("dist"), 6)
    e = A.pairs(a).where("i < j and dist > 1.5").groupBy("id").agg(F.sum(4 * (s6 * s6 - s6)).alias("e"))
    return a.select("id").distinct().join(e, "id", "left").select("id", F.round(F.coalesce("e", F.lit(0.0)), 4).alias("energy"))


@query(f"with {T}, h as (select *, max(z) over (partition by id) as zmax from a) select id, idx from h where z >= zmax - 0.1 or not exists (select 1 from a o where o.id = h.id and o.z > h.z + 0.1 and sqrt((o.x-h.x)*(o.x-h.x) + (o.y-h.y)*(o.y-h.y)) < 1.5)")
def exposed_atoms(spark: SparkSession, d: str) -> DataFrame:
    return A.exposed(_a(spark, d), 1.5).select("id", "idx")


@query(f"with {T} select id, idx, dense_rank() over (partition by id order by z) <= 2 as fixed, round(z - min(z) over (partition by id) + 2.0, 6) as z from a")
def fixed_layers(spark: SparkSession, d: str) -> DataFrame:
    return A.to_bottom(A.bottom_layers(_a(spark, d), 2)).select("id", "idx", "fixed", F.round("z", 6).alias("z"))


@query(f"with {T} select id, round(sum(mass * x) / sum(mass), 6) as x, round(sum(mass * y) / sum(mass), 6) as y, round(sum(mass * z) / sum(mass), 6) as z from r group by id")
def centre_of_mass(spark: SparkSession, d: str) -> DataFrame:
    m = A.centre_of_mass(_a(spark, d), F.when(F.col("element") == "Ni", 58.693).otherwise(47.867))
    return m.select("id", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(f"with {T}, w as (select id, z, z - lag(z) over (partition by id order by z) as gap from a), v as (select id, x, x - lag(x) over (partition by id order by x) as gap from a) select i.id, case when coalesce(gx, 0) >= coalesce(gz, 0) then 'x' else 'z' end as vacuum_axis from (select distinct id from a) i left join (select id, round(max(gap), 6) as gx from v group by id) using (id) left join (select id, round(max(gap), 6) as gz from w group by id) using (id)")
def vacuum_axis(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    a = _a(spark, d)
    gap = lambda c: F.col(c) - F.lag(c).over(Window.partitionBy("id").orderBy(c))
    g = a.withColumn("gx", gap("x")).withColumn("gz", gap("z")).groupBy("id").agg(F.round(F.max("gx"), 6).alias("gx"), F.round(F.max("gz"), 6).alias("gz"))
    return g.select("id", F.when(F.coalesce("gx", F.lit(0.0)) >= F.coalesce("gz", F.lit(0.0)), "x").otherwise("z").alias("vacuum_axis"))


@query(f"with {T}, e as (select *, unnest([1, 2]) as copy from a) select id, copy, idx, " + ", ".join(f"round({c} + 0.03 * {seeded.sql_normal(f'4{c}', 'id', 'copy', 'idx')}, 5) as {c}" for c in "xyz") + " from e")
def rattle(spark: SparkSession, d: str) -> DataFrame:
    return A.rattled(_a(spark, d), 2, 0.03, 4).select("id", "copy", "idx", *[F.round(c, 5).alias(c) for c in "xyz"])


@query(f"with c as (select p_partkey as id, unnest([0, 1, 2]) as k, p_size::double as len from part), e as (select *, unnest([1, 2]) as copy from c) select id, copy, k, round(len * (1 + case when {seeded.sql_uniform('8s', 'id', 'copy', 'k')} < 0.5 then -1.0 else 1.0 end * (0.01 + 0.04 * {seeded.sql_uniform(8, 'id', 'copy', 'k')})), 6) as len from e")
def deform(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"), F.col("p_size").cast("double").alias("len"))
    return A.deformed(c, "len", 0.01, 0.05, 2, 8).select("id", "copy", "k", F.round("len", 6).alias("len"))


@query(f"with {T}, n as (select *, count(*) over (partition by id) as n, row_number() over (partition by id order by {seeded.sql_uniform('6v', 'id', 'idx')}, idx) as k from a) select id, idx, element from n where k > least(floor(n * (0.1 + 0.3 * {seeded.sql_uniform(6, 'id')})), n - 1)")
def vacancies(spark: SparkSession, d: str) -> DataFrame:
    return A.with_vacancies(_a(spark, d), 0.1, 0.4, 6).select("id", "idx", "element")


@query(f"with {T}, n as (select *, row_number() over (partition by id, element = 'Ni' order by {seeded.sql_uniform(2, 'id', 'idx')}, idx) as k from a) select id, idx, case when element = 'Ni' and k <= 2 then 'Cu' else element end as element from n")
def replacement(spark: SparkSession, d: str) -> DataFrame:
    return A.replaced(_a(spark, d), "Ni", "Cu", F.lit(2), 2).select("id", "idx", "element")


@query("select p_partkey as id, a::int as a, b::int as b, c::int as c, (p_size * a * b * c)::int as total from part, (select unnest(range(1, 6)) as a), (select unnest(range(1, 6)) as b), (select unnest(range(1, 6)) as c) where p_size * a * b * c > 40 and p_size * a * b * c < 80")
def supercells(spark: SparkSession, d: str) -> DataFrame:
    return A.supercells(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size"), "p_size", 40, 80).select("id", "a", "b", "c", "total")


@query("select n, ((10 * n * n * n + 15 * n * n + 11 * n) // 3 + 1)::bigint as atoms from (select unnest(range(1, 26)) as n)")
def magic_clusters(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(A.magic_numbers()).alias("n", "atoms")).select((F.col("n") + 1).cast("long").alias("n"), "atoms")


@query("select distinct regexp_extract(x, '^([A-Z][a-z]?)', 1) as element, 10.0::double as vacuum from (select unnest(regexp_extract_all(formula, '[A-Z][a-z]?\\d*')) as x from structures)")
def isolated_atoms(spark: SparkSession, d: str) -> DataFrame:
    from latticework.functions.scalar import composition

    e = table(spark, d, "structures").where("formula is not null").select(F.explode(F.transform(composition("formula"), lambda p: p["element"])).alias("element")).distinct()
    return e.withColumn("vacuum", F.lit(10.0))


@query("select phase, param, value::double as value, value = max(value) over (partition by param) as is_ref from (select distinct coalesce(lower(trim(phase)), 'unknown') as phase from structures), (select 'encut' as param, unnest([300.0, 400.0, 500.0]) as value union all select 'kspacing', unnest([0.2, 0.3]))")
def sweep_grid(spark: SparkSession, d: str) -> DataFrame:
    phases = table(spark, d, "structures").select(F.coalesce(F.lower(F.trim("phase")), F.lit("unknown")).alias("phase")).distinct()
    grid = [("encut", v, v == 500.0) for v in (300.0, 400.0, 500.0)] + [("kspacing", v, v == 0.3) for v in (0.2, 0.3)]
    each = F.array(*[F.struct(F.lit(p).alias("param"), F.lit(v).alias("value"), F.lit(r).alias("is_ref")) for p, v, r in grid])
    return phases.select("phase", F.explode(each).alias("g")).select("phase", "g.*")


@query("with c as (select p_partkey as id, p_size + 2.5 as a, p_size + 30.0 as h from part) select id, greatest(1, round_even(2 * pi() / (a * sin(pi() / 3)) / 0.2, 0))::int as ka, greatest(1, round_even(2 * pi() / (a * sin(pi() / 3)) / 0.2, 0))::int as kb, 1 as kc from c")
def k_mesh(spark: SparkSession, d: str) -> DataFrame:
    """Hexagonal cells with a vacuum along the third axis."""
    import math

    a = F.col("p_size") + 2.5
    zero = F.lit(0.0)
    cell = F.array(a, zero, zero, -a / 2, a * math.sin(math.pi / 3), zero, zero, zero, F.col("p_size") + 30.0)
    mesh = A.kmesh(A.reciprocal_lengths(cell), 0.2, F.lit(2))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), mesh[0].alias("ka"), mesh[1].alias("kb"), mesh[2].alias("kc"))


@query("with e as (select vec_id, label, embedding::double[] as v from embeddings), x as (select b.vec_id, min(a.vec_id) as first from e a join e b on a.label = b.label and a.vec_id < b.vec_id where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.25 group by 1) select vec_id, first from x")
def repeats_any(spark: SparkSession, d: str) -> DataFrame:
    return repeats.any_earlier(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), ["label"], "vec_id", "embedding", 64, 0.25)


@query("""with recursive e as (select vec_id, label, embedding::double[] as v, row_number() over (partition by label order by vec_id) as k from embeddings), u as (select vec_id, label, k, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from e),
g as (select label, k, vec_id, null::bigint as repeat_of, [{'id': vec_id, 'v': v}] as kept from u where k = 1 union all
select label, k, vec_id, b.id as repeat_of, case when b.id is null then list_append(kept, {'id': vec_id, 'v': v}) else kept end as kept
from (select u.label, u.k, u.vec_id, u.v, g.kept, list_max(list_filter(list_transform(g.kept, lambda x: {'s': list_dot_product(x.v, u.v), 'o': -x.id, 'id': x.id}), lambda x: x.s >= 0.25)) as b from g join u on u.label = g.label and u.k = g.k + 1))
select vec_id, repeat_of from g""")
def repeats_greedy(spark: SparkSession, d: str) -> DataFrame:
    return repeats.greedy(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), ["label"], "vec_id", "embedding", 0.25)
