"""Queries of slabs, dimers, distortions, features and penalties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import seeded
from latticework.operators import atoms as A
from latticework.operators import builders as B
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


_DIM = "d as (select unnest([" + ", ".join("{" + f"'symbol': '{s}', 'a': {'null' if v[0] is None else v[0]}, 'lattice': " + ("null" if v[1] is None else f"'{v[1]}'") + f", 'radius': {v[2]}" + "}" for s, v in B.ELEMENTS.items()) + "], recursive := true))"


@query(f"with {_DIM}, e as (select distinct regexp_extract(x, '^([A-Z][a-z]?)', 1) as symbol from (select unnest(regexp_extract_all(formula, '[A-Z][a-z]?\\d*')) as x from structures)) select symbol, round(case when lattice = 'fcc' then a / sqrt(2) when lattice = 'bcc' then a * sqrt(3) / 2 when lattice is not null then a else 2 * radius end, 6) as distance from e join d using (symbol)")
def neighbour_distances(spark: SparkSession, d: str) -> DataFrame:
    from latticework.functions.scalar import composition

    e = table(spark, d, "structures").where("formula is not null").select(F.explode(F.transform(composition("formula"), lambda p: p["element"])).alias("symbol")).distinct()
    return e.join(F.broadcast(B.elements(spark)), "symbol").select("symbol", F.round(B.neighbour_distance(F.col("a"), F.col("lattice"), F.col("radius")), 6).alias("distance"))


@query("select p_partkey as id, i as idx, round(i * (2.0 + p_size / 100.0) * 1.1, 6) as x from part, (select unnest([0, 1])::int as i)")
def dimers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("Cu").alias("element"), (2.0 + F.col("p_size") / 100.0).alias("distance"))
    return B.dimers(p, 1.1).select("id", "idx", F.round("x", 6).alias("x"))


def _oct(i: int, c: str) -> str:
    ax, size = f"floor(6 * {seeded.sql_uniform('5x', 'id', 'copy', 'idx')})", f"(0.2 * {seeded.sql_uniform('5s', 'id', 'copy', 'idx')})"
    return f"round({c} + case when element <> 'Ti' then 0 when {ax} = {2 * i} then {size} when {ax} = {2 * i + 1} then -{size} else 0 end, 6) as {c}"


@query(f"with {T}, e as (select *, unnest([1, 2]) as copy from a) select id, copy, idx, " + ", ".join(_oct(i, c) for i, c in enumerate("xyz")) + " from e")
def octahedral(spark: SparkSession, d: str) -> DataFrame:
    return B.octahedral(_a(spark, d), "Ti", 0.2, 2, 5).select("id", "copy", "idx", *[F.round(c, 6).alias(c) for c in "xyz"])


@query()
def slabs(spark: SparkSession, d: str) -> DataFrame:
    bulks = B.elements(spark).where("lattice in ('fcc', 'bcc')").select(F.col("symbol").alias("id"), F.col("symbol").alias("element"), "a", "lattice")
    return B.slabs(bulks, 2, 6, 10.0).groupBy("id", "plane").agg(F.count(F.lit(1)).alias("n_atoms"), F.round(F.first("area"), 4).alias("area"), F.round(F.max("z") - F.min("z"), 4).alias("thickness"))


@query(f"select p_partkey as id, round(0.62 + (0.98 - 0.62) * {seeded.sql_uniform(12, 'p_partkey')}, 6) as share, case when ceil(0.3 * p_size - 1e-9) - p_partkey % 40 > 0 then ceil(0.3 * p_size - 1e-9) - p_partkey % 40 when p_partkey % 40 - floor(0.6 * p_size + 1e-9) > 0 then -(p_partkey % 40 - floor(0.6 * p_size + 1e-9)) else 0 end::bigint as change from part")
def replacement_counts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.round(B.percentage(0.6, 1.0, 0.02, 12, "p_partkey"), 6).alias("share"), B.replacements_to_fit(F.col("p_size"), F.col("p_partkey") % 40, 0.3, 0.6).alias("change"))


@query("with s as (select avg(p_size) as m1, stddev_pop(p_size) as s1, avg(p_retailprice) as m2, stddev_pop(p_retailprice) as s2 from part) select p_partkey as id, round((p_size - m1) / s1, 6) as f1, round((p_retailprice - m2) / s2, 6) as f2, 0.0::double as f3 from part, s")
def features(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice", F.lit(3.0).alias("same"))
    f = F.col("features")
    return B.with_features(p, "id", ["p_size", "p_retailprice", "same"]).select("id", F.round(f[0], 6).alias("f1"), F.round(f[1], 6).alias("f2"), f[2].alias("f3"))


@query("with s as (select vec_id, embedding::double[] as v from embeddings order by md5('420:' || vec_id), vec_id limit 10000), d as (select sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) as d from s a join s b on a.vec_id < b.vec_id) select count(*) as n_pairs, round(quantile_cont(d, 0.1), 6) as p10, round(quantile_cont(d, 0.5), 6) as median, round(quantile_cont(d, 0.9), 6) as p90 from d")
def kernel_width(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    w = B.kernel_width(e, "vec_id", "v", 10_000)
    return w.select("n_pairs", *[F.round(c, 6).alias(c) for c in ("p10", "median", "p90")])


@query(f"with {T}, {PAIRS}, q as (select id, i, j, dist, least(case when dist > 0 then 0.7 * rr / dist else 10.0 end, 10.0) as ratio, rr from p), s as (select id, i, sum(case when i < j and ratio > 1 then pow(ratio, 6) - 1 else 0 end) as r, sum(1 / (1 + exp((dist - 1.1 * rr) / 0.25))) as c from q group by 1, 2) select id, round(sum(r), 3) as repulsion, round(sum(pow(greatest(2.0 - c, 0), 2)), 5) as cohesion from s group by id")
def penalties(spark: SparkSession, d: str) -> DataFrame:
    p = B.penalties(A.pairs(_a(spark, d), _radius()), 0.7, 1.1)
    return p.select("id", F.round("repulsion", 3).alias("repulsion"), F.round("cohesion", 5).alias("cohesion"))


@query("with e as (select vec_id, embedding::double[] as v from embeddings) select vec_id, round(v[1] + 2 * v[2], 6) as x, round(v[3] - v[64], 6) as y from e")
def encoded(spark: SparkSession, d: str) -> DataFrame:
    w = np.zeros((64, 2))
    w[0, 0], w[1, 0], w[2, 1], w[63, 1] = 1, 2, 1, -1
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    out = B.encode(e, "vec_id", "v", [(w, np.zeros(2))], np.zeros(64), np.ones(64))
    return out.select("vec_id", F.round(F.col("latent")[0], 6).alias("x"), F.round(F.col("latent")[1], 6).alias("y"))


@query("with e as (select unnest(embedding::double[]) as a from embeddings), d as (select a, a - 0.9 * a as d from e) select round(avg(abs(d)), 6) as mae, round(avg(d * d), 8) as mse, round(sqrt(avg(d * d)), 6) as rmse, round(avg(d * d) / var_pop(a), 6) as relative from d")
def reconstruction(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    out = B.reconstruction(e.withColumn("b", F.transform("v", lambda x: x * 0.9)), "v", "b")
    return out.select(F.round("mae", 6).alias("mae"), F.round("mse", 8).alias("mse"), F.round("rmse", 6).alias("rmse"), F.round("relative", 6).alias("relative"))
