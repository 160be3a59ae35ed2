"""Sources and sinks written and read again, plug-ins, settings."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import config, plugins, scalar
from latticework.operators import checks, linking, runs
from latticework.session import scratch_root, table
from latticework.sources import tables

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _place(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{uuid.uuid4().hex[:12]}-{name}"


# sources and sinks


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """part plays the structures: a frame of 1 + p_size % 4 atoms."""
    atom = lambda i: F.struct(i.cast("int").alias("idx"), F.when(i % 2 == 0, "Ni").otherwise("Ti").alias("symbol"), (i * 1.5).alias("x"), (F.col("p_size") * 0.25).alias("y"), F.lit(0.0).alias("z"), (i * 0.125).alias("fx"), F.lit(0.0).alias("fy"), F.lit(-0.5).alias("fz"))
    atoms = F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), atom)
    info = F.create_map(F.lit("atl_id"), F.concat(F.lit("s "), F.col("p_partkey").cast("string")), F.lit("phase"), F.col("p_brand"), F.lit("REF_energy"), F.col("p_retailprice").cast("string"))
    return table(spark, d, "part").select(F.lit("").alias("file"), F.col("p_partkey").alias("pos"), info.alias("info"), F.array(*[F.lit(float(x)) for x in (9, 0, 0, 0, 9, 0, 0, 0, 9)]).alias("cell"), F.array(*[F.lit(True)] * 3).alias("pbc"), atoms.alias("atoms"))


@query("select p_partkey as id, p_brand as phase, p_retailprice as energy, 1 + p_size % 4 as n_atoms, round(1.5 * (p_size % 4) * (p_size % 4 + 1) / 2, 6) as sum_x, round((1 + p_size % 4) * -0.5, 6) as sum_fz from part")
def xyz_written_and_read(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark, "frames.xyz")
    tables.write(_frames(spark, d), at)
    back = tables.read(spark, at)
    total = lambda c: F.round(F.aggregate(f"atoms.{c}", F.lit(0.0), lambda a, x: a + x), 6)
    return back.select(F.substring(F.col("info")["atl_id"], 3, 20).cast("long").alias("id"), F.col("info")["phase"].alias("phase"), F.col("info")["REF_energy"].cast("double").alias("energy"), F.size("atoms").alias("n_atoms"), total("x").alias("sum_x"), total("fz").alias("sum_fz"))


@query("select f.format, p_brand as brand, count(*) as n, sum(p_size)::bigint as sizes, round(sum(p_retailprice), 4) as prices from part, (select unnest(['parquet', 'json', 'csv', 'orc']) as format) f group by 1, 2")
def formats_written_and_read(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    out = []
    for kind in ("parquet", "json", "csv", "orc"):
        at = _place(spark, f"part.{kind}")
        tables.write(part, at)
        out.append(tables.read(spark, at, "p_partkey long, p_brand string, p_size int, p_retailprice double").select(F.lit(kind).alias("format"), F.col("p_brand").alias("brand"), "p_size", "p_retailprice"))
    every = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
    return every.groupBy("format", "brand").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("sizes"), F.round(F.sum("p_retailprice"), 4).alias("prices"))


@query("select 'first' as source, count(*) as n from part union all select 'kept', count(*) from part union all select 'overwritten', count(*) from supplier")
def stored_or_computed(spark: SparkSession, d: str) -> DataFrame:
    """A stored table is used, kept when it may not be overwritten, and replaced when it is asked for."""
    at = _place(spark, "cache.parquet")
    first = tables.load_or_compute(spark, at, lambda: table(spark, d, "part").select(F.col("p_partkey").alias("id"))).count()
    tables.write(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), at, keep_existing=True)
    kept = tables.load_or_compute(spark, at, lambda: table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))).count()
    last = tables.load_or_compute(spark, at, lambda: table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), overwrite=True).count()
    return spark.createDataFrame([("first", first), ("kept", kept), ("overwritten", last)], "source string, n long")


@query("select 'after' as moment, count(*) as n, sum(p_size)::bigint as sizes from part")
def failed_write_leaves_the_old(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark, "old.parquet")
    part = table(spark, d, "part").select("p_partkey", "p_size")
    tables.write(part, at)
    try:
        tables.write(part.withColumn("p_size", F.when(F.col("p_partkey") > 0, F.raise_error(F.lit("broken"))).otherwise(F.lit(0))), at)
    except Exception:  # the write fails by design
        pass
    return tables.read(spark, at).agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("sizes")).select(F.lit("after").alias("moment"), "n", "sizes")


@query("select calc_uuid, energy, queue from dft_runs where lower(trim(status)) = 'finished' and energy is not null and not isnan(energy) and energy < -1")
def gathered_labels(spark: SparkSession, d: str) -> DataFrame:
    """Finished runs with a readable energy, outliers put aside, the rest written and read again."""
    r = table(spark, d, "dft_runs")
    done = runs.gathered(r, scalar.nan_to_null("energy"), F.col("status"))
    kept, _ = runs.split_outliers(done, F.col("energy") >= -1)
    at = _place(spark, "labels.parquet")
    tables.write(runs.only(kept, ["calc_uuid", "energy", "queue", "not_there"]), at)
    return tables.read(spark, at)


@query("select 'kept' as side, count(*) as n from dft_runs where lower(trim(status)) = 'finished' and energy is not null and not isnan(energy) and energy < -12 union all select 'aside', count(*) from dft_runs where lower(trim(status)) = 'finished' and energy is not null and not isnan(energy) and energy >= -12")
def outliers_put_aside(spark: SparkSession, d: str) -> DataFrame:
    done = runs.gathered(table(spark, d, "dft_runs"), scalar.nan_to_null("energy"), F.col("status"))
    kept, aside = runs.split_outliers(done, F.col("energy") >= -12)
    return kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("side"), "n").unionByName(aside.agg(F.count(F.lit(1)).alias("n")).select(F.lit("aside").alias("side"), "n"))


@query("select p_partkey as id, chr(49) || chr(10) || 'REF_energy=' || (p_size * 2)::varchar || ' brand=' || replace(p_brand, ' ', '_') || ' job=j' || p_partkey::varchar || chr(10) || printf('Ni %.6f %.6f %.6f', p_size * 0.5, p_size * 0.25, 0.0::double) as entry from part")
def training_entries(spark: SparkSession, d: str) -> DataFrame:
    """Keys renamed, information of the job added, stress dropped, one text per structure."""
    size = F.col("p_size")
    info = F.create_map(F.lit("temp_energy"), (size * 2).cast("string"), F.lit("brand"), F.replace("p_brand", F.lit(" "), F.lit("_")), F.lit("stress"), F.lit("0"))
    info = runs.renamed(info, {"temp_energy": "REF_energy"})
    info = runs.with_info(info, F.create_map(F.lit("job"), F.concat(F.lit("j"), F.col("p_partkey").cast("string"))))
    atoms = F.array(F.struct(F.lit("Ni").alias("symbol"), (size * 0.5).alias("x"), (size * 0.25).alias("y"), F.lit(0.0).alias("z")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), runs.entry(F.lit(1), info, atoms, ("stress", "REF_stress")).alias("entry"))


@query("select p_partkey as id, 'begin' || chr(10) || 'comment p' || p_partkey::varchar || chr(10) || printf('atom %16.8f %16.8f %16.8f Cu 0.0 0.0 %16.8f %16.8f %16.8f', p_size / 0.529177210903, 0.0::double, 0.0::double, 0.0::double, p_size / (27.211386245988 / 0.529177210903), 0.0::double) || chr(10) || printf('energy %.8f', p_retailprice / 27.211386245988) || chr(10) || 'charge 0.0' || chr(10) || 'end' as record from part")
def n2p2_records(spark: SparkSession, d: str) -> DataFrame:
    atom = F.struct(F.lit("Cu").alias("symbol"), F.col("p_size").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("fx"), F.col("p_size").cast("double").alias("fy"), F.lit(0.0).alias("fz"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), tables.n2p2_record(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.array(atom), F.col("p_retailprice")).alias("record"))


@query("with x as (select lower(regexp_replace(atl_id, '[^A-Za-z0-9]', '', 'g')) as key, descriptors from descriptor_dict where descriptors is not null and len(descriptors) = 64) select count(*) as n, count(distinct key) as ids, round(sum(coalesce(case when isfinite(descriptors[1]) then descriptors[1]::double end, 0)), 4) as total from x")
def descriptors_saved(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark, "descriptors.parquet")
    rows = table(spark, d, "descriptor_dict").where(F.size("descriptors") == 64).select(F.lower(F.regexp_replace("atl_id", "[^A-Za-z0-9]", "")).alias("key"), "descriptors")
    back = tables.load_or_compute(spark, at, lambda: rows)
    first = F.col("descriptors")[0].cast("double")
    fine = F.when(~F.isnan(first) & (F.abs(first) < float("inf")), first).otherwise(0.0)
    return back.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("ids"), F.round(F.sum(F.coalesce(fine, F.lit(0.0))), 4).alias("total"))


# settings


def _toml(spark: SparkSession, d: str, run, form: str) -> DataFrame:
    def each(frames):
        for f in frames:
            yield pd.DataFrame([r for i, t in zip(f["id"], f["toml"], strict=True) for r in run(int(i), config.parse_toml(t))], columns=[c.split()[0] for c in form.split(", ")])

    return table(spark, d, "config_snapshots").where("toml is not null").select("id", "toml").mapInPandas(each, form)


@query("select id, regexp_extract(toml, '\\[(\\w+)\\]', 1) as section, 'max_batch' as key, regexp_extract(toml, 'max_batch = (\\d+)', 1)::double as value from config_snapshots where toml is not null union all select id, regexp_extract(toml, '\\[(\\w+)\\]', 1), 'cutoff', regexp_extract(toml, 'cutoff = ([\\d.]+)', 1)::double from config_snapshots where toml is not null")
def toml_values(spark: SparkSession, d: str) -> DataFrame:
    return _toml(spark, d, lambda i, t: [(i, s, k, float(v)) for s, part in t.items() for k, v in part.items()], "id long, section string, key string, value double")


_SCHEMA = {s: {"max_batch": {"type": "int", "choices": [8, 12, 16, 20, 24, 28, 32]}, "cutoff": {"type": "float"}, "queue": {"type": "str", "default": "normal"}, "nodes": {"type": "int", "mandatory": True, "depends_on": {f"{s}.max_batch": [40, 44]}}} for s in ("dft", "training", "md")}


@query("select id, regexp_extract(toml, '\\[(\\w+)\\]', 1) as section, case when regexp_extract(toml, '\\[(\\w+)\\]', 1) not in ('dft', 'training', 'md') then 0 else (regexp_extract(toml, 'max_batch = (\\d+)', 1)::int not in (8, 12, 16, 20, 24, 28, 32))::int + (regexp_extract(toml, 'max_batch = (\\d+)', 1)::int in (40, 44))::int end as errors, (regexp_extract(toml, '\\[(\\w+)\\]', 1) not in ('dft', 'training', 'md'))::int as warnings, case when regexp_extract(toml, '\\[(\\w+)\\]', 1) in ('dft', 'training', 'md') then 'normal' end as queue from config_snapshots where toml is not null")
def settings_checked(spark: SparkSession, d: str) -> DataFrame:
    def run(i: int, t: dict) -> list[tuple]:
        section = next(iter(t))
        errors, warnings = config.validate(t, _SCHEMA)
        return [(i, section, len(errors), len(warnings), config.with_defaults(t, _SCHEMA)[section].get("queue"))]

    return _toml(spark, d, run, "id long, section string, errors int, warnings int, queue string")


@query("select string_agg(line, chr(10) order by section, o) || chr(10) as snippet from (select section, 1 as o, case when row_number() over (order by section) > 1 then chr(10) else '' end || '[' || section || ']' || chr(10) || 'cutoff = ' || printf('%.2f', c)::double::varchar || chr(10) || 'max_batch = ' || b::varchar || '.0' as line from (select section, max(regexp_extract(toml, 'cutoff = ([\\d.]+)', 1)::double) as c, max(regexp_extract(toml, 'max_batch = (\\d+)', 1)::int) as b from config_snapshots group by 1))")
def settings_recommended(spark: SparkSession, d: str) -> DataFrame:
    """The best values of a finished sweep as a settings text."""
    best = toml_values(spark, d).groupBy("section", "key").agg(F.max("value").alias("value")).collect()  # a few settings
    text = config.recommendation([(r["section"], r["key"], r["value"]) for r in best])
    assert config.parse_toml(text)
    return spark.createDataFrame([(text,)], "snippet string")


@query("select p_partkey as id, p_size::varchar as cores, case when p_size % 3 = 0 then 'gpu' else 'cpu' end as queue, case when p_size % 2 = 0 then 'singularity' end as engine from part")
def settings_overridden(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    base = F.create_map(F.lit("queue"), F.lit("cpu"), F.lit("cores"), F.col("p_size").cast("string"))
    over = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("queue"), F.lit("gpu")))
    more = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("engine"), F.lit("singularity")))
    m = linking.overridden(linking.overridden(base, over), more)
    return p.select(F.col("p_partkey").alias("id"), *[m[k].alias(k) for k in ("cores", "queue", "engine")])


# plug-ins


def _offer() -> None:
    plugins.register_backend("twice", energies=lambda b: b["p_size"] * 9.0)
    plugins.register_backend("twice", energies=lambda b: b["p_size"] * -0.5, descriptors=lambda b: [np.outer(range(1 + s % 3), [1.0, s]) for s in b["p_size"]], confidence=lambda b: [[s / 10, s / 20] for s in b["p_size"]], train=lambda b: b)
    plugins.register_backend("once", energies=lambda b: b["p_size"] * -0.25, gradients=lambda b: b, compile=lambda b: b)
    plugins.register_backend("walk", frames=lambda b: [[s * 0.5 * i for i in range(3)] for s in b["p_size"]])
    plugins.register_backend("ready", pretrained=lambda name: name)

    def breaks(b):
        raise RuntimeError("no energy")

    plugins.register_backend("broken", energies=breaks)


@query("select * from (values ('broken', false, true), ('once', false, true), ('ready', false, false), ('twice', true, true)) t(name, trainable, gives_energies)")
def backends_listed(spark: SparkSession, d: str) -> DataFrame:
    _offer()
    mine = ("broken", "once", "ready", "twice")
    return spark.createDataFrame([(n, n in plugins.backends("train"), n in plugins.backends("energies")) for n in plugins.backends() if n in mine], "name string, trainable boolean, gives_energies boolean")


@query("select p_partkey, m.model, case m.model when 'twice' then p_size * -0.5 when 'once' then p_size * -0.25 end as energy from part, (select unnest(['twice', 'once', 'broken']) as model) m")
def committee_of_backends(spark: SparkSession, d: str) -> DataFrame:
    _offer()
    return plugins.committee(table(spark, d, "part"), ["twice", "once", "broken"], ["p_size"], "p_partkey")


@query("select p_partkey, a::int as atom_idx, a::double as e1, a::double * p_size as e2 from part, (select unnest(range(0, 3)) as a) where a < 1 + p_size % 3")
def described_by_a_backend(spark: SparkSession, d: str) -> DataFrame:
    _offer()
    e = F.col("embedding")
    return plugins.describe(table(spark, d, "part"), "twice", ["p_size"], "p_partkey").select("p_partkey", "atom_idx", e[0].cast("double").alias("e1"), e[1].cast("double").alias("e2"))


@query("select p_partkey, i::int as frame, p_size * 0.5 * i as energy from part, (select unnest(range(3)) as i)")
def simulated_frames(spark: SparkSession, d: str) -> DataFrame:
    _offer()
    return plugins.trajectories(table(spark, d, "part"), "walk", ["p_size"], "p_partkey")


@query("select p_partkey, p_size / 10.0::double as confidence from part")
def confidence_of_a_backend(spark: SparkSession, d: str) -> DataFrame:
    _offer()
    return plugins.confidence(table(spark, d, "part"), "twice", ["p_size"], "p_partkey")


@query("select (p_size * -0.5) < -20 as refused, count(*) as n from part group by 1")
def unphysical_energies(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("p_size") * -0.5
    return table(spark, d, "part").groupBy((~plugins.physical(e, F.lit(1), 20.0)).alias("refused")).agg(F.count(F.lit(1)).alias("n"))


# small functions


@query("select p_partkey as id, (p_partkey % 4)::int as h, (p_size % 3)::int as k, -1::int as l, (p_partkey % 4)::varchar || (p_size % 3)::varchar || '-1' as label, 0 as h0, 0 as k0, 1 as l0 from part")
def miller_indices(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string("[%d, %d, -1]", F.col("p_partkey") % 4, F.col("p_size") % 3)
    m, none = scalar.miller(text), scalar.miller(F.lit(None).cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), *[m[i].cast("int").alias(c) for i, c in enumerate("hkl")], scalar.miller_label(text).alias("label"), *[none[i].cast("int").alias(f"{c}0") for i, c in enumerate("hkl")])


@query("with k as (select a.n_regionkey as a, b.n_regionkey as b, avg(exp(-(pow((a.n_nationkey - b.n_nationkey) / 10.0, 2) + pow((a.n_regionkey - b.n_regionkey) / 2.0, 2)) / (2 * 0.8 * 0.8))) as v from nation a, nation b group by 1, 2) select k.a, k.b, round(k.v / sqrt(x.v * y.v), 6) as kernel from k join k x on x.a = k.a and x.b = k.a join k y on y.a = k.b and y.b = k.b where k.a <= k.b")
def average_kernels(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.array(F.col("n_nationkey") / 10, F.col("n_regionkey") / 2))).alias("m"))
    k = checks.average_kernel(n.orderBy("n_regionkey"), "n_regionkey", "m", 0.8)
    return k.select("a", "b", F.round("kernel", 6).alias("kernel"))


@query("select 0.529177210903::double as bohr, 27.211386245988::double as hartree, 8.617333262e-05::double as boltzmann")
def units(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.lit(tables.BOHR).alias("bohr"), F.lit(tables.HARTREE).alias("hartree"), F.lit(tables.BOLTZMANN).alias("boltzmann"))
