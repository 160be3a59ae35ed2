"""Queries of text rules, of pipelines, of streaming views and of formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import texts as X
from latticework.plans import analysis, cleanup
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


@query("with g as (select user_id as job, count(*) filter (where value <= 30) as a, count(*) filter (where value > 30 and value <= 60) as b, count(*) filter (where value > 60) as c, count(*) as n from events group by 1) select job, a || ' interpolating (' || printf('%.1f', floor(1000.0 * a / n + 0.5) / 10) || ' %), ' || b || ' extrapolating (' || printf('%.1f', floor(1000.0 * b / n + 0.5) / 10) || ' %), ' || c || ' out of domain' as sentence from g")
def domain_sentence(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("job")).agg(F.count_if(F.col("value") <= 30).alias("a"), F.count_if((F.col("value") > 30) & (F.col("value") <= 60)).alias("b"), F.count_if(F.col("value") > 60).alias("c"), F.count(F.lit(1)).alias("n"))
    return g.select("job", X.domain_sentence(F.col("a"), F.col("b"), F.col("c"), F.col("n")).alias("sentence"))


@query("select calc_uuid, recorded_at, case when lower(status) = 'finished' then case when aiida_pk % 2 = 0 then 'completed' else 'failed' end when lower(status) in ('excepted', 'killed') then 'failed' when lower(status) in ('created', 'waiting', 'running') then 'running' else 'unknown' end as node_status from dft_runs")
def node_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dft_runs").select("calc_uuid", "recorded_at", X.node_status(F.col("status"), F.col("aiida_pk") % 2).alias("node_status"))


@query("select run_id, iteration, refreshed_at, coalesce(nullif(regexp_extract(regexp_extract(model_path, '[^/]*$'), '^.[^.]*(\\..+)$', 1), ''), '.model') as ext, regexp_extract(model_path, '[^/]*$') as file from al_iterations where model_path is not null")
def model_files(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "al_iterations").where("model_path is not null")
    return t.select("run_id", "iteration", "refreshed_at", X.file_ext(F.col("model_path")).alias("ext"), F.element_at(F.split("model_path", "/"), -1).alias("file"))


@query("select id, regexp_extract(toml, 'max_batch = (\\d+)', 1)::bigint as max_batch, regexp_extract(toml, 'cutoff = ([\\d.]+)', 1)::double as cutoff from config_snapshots")
def config_values(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "config_snapshots").select("id", X.settings(F.col("toml")).alias("m"))
    return m.select("id", F.try_element_at("m", F.lit("MAX_BATCH")).try_cast("bigint").alias("max_batch"), F.try_element_at("m", F.lit("CUTOFF")).try_cast("double").alias("cutoff"))


@query("select l_orderkey as id, l_linenumber as n, count(*) as rows, case l_suppkey % 3 when 0 then 'mace' when 1 then 'orb' else 'mace' end as backend from lineitem group by 1, 2, 4")
def model_specs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    spec = F.when(F.col("l_suppkey") % 3 == 0, "mace:small").when(F.col("l_suppkey") % 3 == 1, "orb:v2").otherwise("/models/c:own.model")
    return li.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), X.model_backend(spec, ["mace", "orb"], "mace").alias("backend")).agg(F.count(F.lit(1)).alias("rows"))


@query("select o_orderkey as id, (o_orderkey % 3) * 86400 + (o_custkey % 24) * 3600 + (o_orderkey % 60) * 60 + 7 as seconds, (o_custkey % 64)::int as cores from orders")
def scheduler_text(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    text = F.format_string("JobID|NCPUS|Elapsed\n%d|%d|%d-%02d:%02d:07", "o_orderkey", F.col("o_custkey") % 64, F.col("o_orderkey") % 3, F.col("o_custkey") % 24, F.col("o_orderkey") % 60)
    return o.select(F.col("o_orderkey").alias("id"), X.runtime(text).alias("seconds"), X.cores(text).alias("cores"))


@query(SQL_FLAGGED + """, h as (select *, case when isolated_atom then null when n_atoms not between 8 and 32 then 'atom_count' when phase is null then 'no_phase' end as reason from f),
k as (select *, row_number() over (partition by reason is null, phase, formula, n_atoms, energy order by recorded_at, atl_id) as nth from h)
select case when reason is not null then 'filter' when nth > 1 then 'duplicate' else 'kept' end as fate, count(*) as n from k group by 1""")
def cleanup_plan(spark: SparkSession, d: str) -> DataFrame:
    done = cleanup.clean(table(spark, d, "structures"), {"atom_count": {"least": 8, "most": 32}, "positive_energy": False, "no_phase": True})
    return done.report.groupBy("fate").agg(F.sum("n").alias("n"))


@query()
def diversity_growth(spark: SparkSession, d: str) -> DataFrame:
    from latticework.functions.ids import id_key

    s = table(spark, d, "split_members").select(id_key("atl_id").alias("key"), F.when(F.lower(F.trim("split_name")) == "train", 0).when(F.lower(F.trim("split_name")) == "valid", 1).otherwise(2).alias("step")).groupBy("key").agg(F.min("step").alias("step"))
    p = table(spark, d, "descriptor_dict").select(id_key("atl_id").alias("key"), F.explode("latent_space").alias("p")).groupBy("key").agg(F.avg(F.col("p")[0].cast("double")).alias("x"), F.avg(F.col("p")[1].cast("double")).alias("y"))
    out = analysis.growth(s.join(p, "key"), "key", "x", "y", [0, 1, 2], size=10_000, grid=0.2)
    return out.select("upto", "n", *[F.round(c, 4).alias(c) for c in ("vendi", "vendi_std", "vendi_share", "area", "area_added", "area_ratio")])


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def streaming_counters(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    from latticework.streaming.views import counters

    name = f"counters_{uuid.uuid4().hex[:8]}"
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    q = counters(stream, ["event_type"], "value").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("event_type", "n", F.round("total", 4).alias("total"))


@query("select phase, round(sum(n_atoms), 0)::bigint as atoms, count(*) as n from (select lower(trim(phase)) as phase, n_atoms from structures where formula is not null and n_atoms is not null) group by phase")
def text_round_trip(spark: SparkSession, d: str) -> DataFrame:
    from latticework.sources.tables import from_text, to_text

    s = table(spark, d, "structures").where("formula is not null and n_atoms is not null").select(F.lower(F.trim("phase")).alias("phase"), "n_atoms")
    back = from_text(to_text(s), "phase string, n_atoms long")
    return back.groupBy("phase").agg(F.sum("n_atoms").alias("atoms"), F.count(F.lit(1)).alias("n"))
