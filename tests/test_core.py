from __future__ import annotations

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions import config, geometry, ids, plugins, scalar, texts, vector
from latticework.operators import atoms, committee, diversity, graphs, hulls, latent, linking, records, repeats, selection
from latticework.plans import analysis, cleanup, loop
from latticework.sources import extxyz, logs, tables


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


# records


@pytest.fixture(scope="module")
def structures(spark):
    t = [datetime(2024, 1, i) for i in range(1, 10)]
    rows = [
        ("a-1", "Ni3Ti", 4, "Alpha ", "bulk", "[]", 1, -20.0, t[0], None),
        ("A1", "Ni3Ti", 4, "alpha", "bulk", '["perturb", "vacancy"]', 0, None, t[1], None),
        ("b2", "Ni3Ti", 4, "alpha", "Bulk", '["PERTURB"]', 1, -20.0, t[2], None),
        ("c3", "Ti", 1, None, "isolated_atom", None, 1, 5.0, t[3], None),
        ("none", "Ni", None, "beta", None, "not json", 1, float("nan"), t[4], None),
    ]
    return spark.createDataFrame(rows, "atl_id string, formula string, n_atoms long, phase string, struct_type string, modifications string, calc_performed int, calc_energy double, recorded_at timestamp_ntz, removed_at timestamp_ntz")


def test_flag_filters_are_a_bag_unless_asked(structures):
    f = records.flagged(structures)
    assert records.keep_any(f, ["perturb", "vacancy"]).count() == 3  # a row with two true flags comes twice
    assert records.keep_any(f, ["perturb", "vacancy"], dedupe=True).count() == 2
    assert records.keep_none(f, ["perturb", "vacancy"]).count() == 3


def test_reasons_exemptions_and_nulls(structures):
    f = records.with_reasons(records.flagged(structures), {"a": F.col("energy") > 0, "b": F.col("n_atoms") < 4, "c": F.col("phase") == "alpha"}, F.col("isolated_atom"))
    got = {r["atl_id"]: (r["removal_reason"], r["first_reason"]) for r in f.collect()}
    assert got["c3"] == ("", None) and got["a-1"] == ("c", "c") and got["none"] == ("", None)


def test_unknown_convergence_goes_only_on_request(spark):
    df = spark.createDataFrame([(1, True, None, True), (2, None, None, False), (3, False, None, False), (4, True, False, True)], "id int, scf boolean, ionic boolean, relax boolean")
    a, b, c = F.col("scf"), F.col("ionic"), F.col("relax")
    pick = lambda **k: {r["id"] for r in df.where(records.unconverged(a, b, c, **k)).collect()}
    assert pick() == {3} and pick(need_ionic=True) == {3, 4} and pick(need_ionic=True, drop_unknown=True) == {1, 2, 3, 4}


def test_id_repair_and_cleanup(structures):
    f = records.flagged(structures)
    fix = {r["atl_id"]: (r["repeat"], r["needs_id"]) for r in records.repair_ids(f, "key", "recorded_at").collect()}
    assert fix["a-1"] == (0, False) and fix["A1"] == (1, True) and fix["none"] == (0, True)
    done = cleanup.clean(structures, {"no_phase": True, "atom_count": {"least": 1, "most": 10}})
    assert {r["atl_id"] for r in done.kept.collect()} == {"a-1", "A1", "c3", "none"}
    assert [(r["atl_id"], r["removal_reason"]) for r in done.removed.collect()] == [("b2", "duplicate")]


def test_upsert_keeps_named_columns(spark):
    old = spark.createDataFrame([(1, "x", "t0"), (2, "y", "t0")], "k int, v string, made string")
    new = spark.createDataFrame([(2, None, "t1"), (3, "z", "t1")], "k int, v string, made string")
    assert sorted(map(tuple, records.upsert(old, new, ["k"], keep=["made"]).collect())) == [(1, "x", "t0"), (2, None, "t0"), (3, "z", "t1")]


# scalars


def test_scalars(spark):
    r = one(
        spark, scalar.composition_key(F.lit("Ni3Ti")).alias("a"), scalar.element_fraction(F.lit("Ni3Ti"), "Ni").alias("b"), scalar.in_range(F.lit(50.0), 0.4, 0.6).alias("c"), scalar.in_range(F.lit(0.6), 0.4, 0.6).alias("d"),
        scalar.miller(F.lit("(1, -1, 0)")).alias("e"), scalar.miller(F.lit("?")).alias("f"), scalar.miller_label(F.lit("[1, 0, 1]")).alias("g"), scalar.number_or_null(F.lit("nan")).alias("h"), scalar.whole_or_null(F.lit("x")).alias("i"), scalar.label(F.lit(" Theta  Prime ")).alias("j"),
    )
    assert tuple(r) == ("Ni:3,Ti:1", 0.75, True, False, [1, -1, 0], [0, 0, 1], "101", None, None, "theta_prime")
    ts = [one(spark, scalar.parse_stamp(F.lit(s)).cast("string").alias("t"))["t"] for s in ("2024-03-01T04:05:06Z", "2024-03-01 04:05:06", "2024-03-01T04:05:06+00:00", "2024-03-01", "soon")]
    assert ts == ["2024-03-01 04:05:06"] * 3 + ["2024-03-01 00:00:00", None]


def test_id_spellings(spark):
    rows = spark.createDataFrame([("AB‐12",), (" n/a ",), ("{None}",), ("",), (None,), ("0123456789ABCDEF0123456789abcdef",)], "i string")
    got = [r["t"] for r in rows.select(ids.id_text(ids.id_key("i")).alias("t")).collect()]
    assert got == ["ab12", None, None, None, None, "01234567-89ab-cdef-0123-456789abcdef"]


def test_texts(spark):
    r = one(
        spark, texts.cores(F.lit("JobID|NCPUS\n1|64")).alias("a"), texts.cores(F.lit("slots   16")).alias("b"), texts.cores(F.lit("?")).alias("c"), texts.runtime(F.lit("1-02:03:04")).alias("d"), texts.runtime(F.lit("00:01:02")).alias("e"), texts.runtime(F.lit("x")).alias("f"),
        texts.file_ext(F.lit("a/b.c/m.tar.gz")).alias("g"), texts.calc_type(F.lit(" SCF")).alias("h"), texts.calc_type(F.lit("?")).alias("i"), texts.settings(F.lit("encut = 500 # eV\nISMEAR=0")).alias("j"), texts.domain_sentence(F.lit(0), F.lit(0), F.lit(0), F.lit(0)).alias("k"), texts.pretty(F.lit("rmse_e")).alias("l"),
    )
    assert tuple(r) == (64, 16, None, 93784, 62, None, ".tar.gz", "static", None, {"ENCUT": "500", "ISMEAR": "0"}, "n/a", "Rmse E")


# vectors and geometry


def test_vectors(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    r = one(spark, vector.cosine_distance(a(1, 0), a(0, 2)).alias("a"), vector.cosine_distance(a(0, 0), a(1, 1)).alias("b"), vector.euclidean(a(0, 3), a(4, 0)).alias("c"), vector.outside(a(1, 5), a(0, 0), a(2, 4)).alias("d"), vector.tanimoto_distance(a(1, 1), a(1, 1)).alias("e"))
    assert tuple(r) == (1.0, 1.0, 5.0, True, 0.0)


def test_points_on_an_edge_are_outside(spark):
    square = [(-3.0, -3.0), (3.0, -3.0), (3.0, 3.0), (-3.0, 3.0)]
    pts = [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (-2.9, 2.9), (4.0, 0.0), (0.0, -3.0)]
    got = [r["i"] for r in spark.createDataFrame(pts, "x double, y double").select(geometry.inside(F.col("x"), F.col("y"), square).alias("i")).collect()]
    assert got == [True, False, False, True, False, False] == list(hulls.contains(square, np.array(pts)))
    assert geometry.area(square) == 36 and geometry.scaled(square, 2.0)[2] == (6.0, 6.0) and geometry.centroid(square) == (0.0, 0.0)


def test_hulls():
    rng = np.random.default_rng(0)
    pts = rng.uniform(0, 1, (300, 2))
    tri = hulls.triangulate(pts)
    edges, count = np.unique(np.sort(tri[:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2), 1), axis=0, return_counts=True)
    assert set(count) == {1, 2} and len(pts) - len(edges) + len(tri) == 1
    c, r2 = hulls._circles(pts, tri)
    assert (((pts[None] - c[:, None]) ** 2).sum(2) > r2[:, None] * (1 - 1e-9)).all()
    ring, _ = hulls.concave_hull(pts)
    assert 0.8 < geometry.area(ring) < 1.0
    two = np.concatenate([pts, pts + 5])
    assert len(hulls.alpha_shape(two, 3.0)) >= 2
    leaves = hulls.leaves(two, 10)
    assert sum(x[4] for x in leaves) == 600 and max(x[4] for x in leaves) <= 10
    dense = [x for x in leaves if x[4] >= 5]
    assert len(set(hulls.touching(dense))) >= 2
    mask = hulls.closed_mask(pts, 10, 1)
    assert mask.all() or mask.mean() > 0.9
    with pytest.raises(ValueError):
        hulls.triangulate(np.zeros((hulls.LIMIT + 1, 2)))


def test_latent_neighbourhood(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0), (2, 20.0, 20.0)], "tid int, tx double, ty double")
    p = spark.createDataFrame([(0.0, 0.0), (0.1, 0.0), (5.0, 5.0)], "x double, y double")
    assert sorted(map(tuple, latent.neighbourhood(t, p, 0.5).collect())) == [(1, 2, 0.0), (2, 0, None)]


def test_vendi_scenarios(spark):
    e = np.eye(4)
    rows = lambda m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "id int, v array<double>")
    assert abs(diversity.vendi_linear(rows(e), "v", 4) - 4) < 1e-9
    assert abs(diversity.vendi_linear(rows(np.ones((4, 4))), "v", 4) - 1) < 1e-9
    assert abs(diversity.vendi_linear(rows(e[[0, 0, 1, 1]]), "v", 4) - 2) < 1e-9
    assert abs(diversity.vendi_rbf(np.array([[0.0], [0.0], [100.0], [100.0]]), 1.0) - 2) < 1e-9
    assert diversity.vendi_linear(rows(np.zeros((2, 4))), "v", 4) == 0.0
    got = diversity.vendi_subsampled(rows(np.random.default_rng(0).normal(size=(60, 4))), "id", "v", size=20, rounds=3, sigma=None).collect()
    assert len(got) == 3 and all(r["n"] == 20 and 1 < r["score"] <= 20 for r in got)


def test_farthest_and_circles(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [10.0, 0.0]), (3, [5.0, 0.0]), (4, [10.0, 0.0])], "id int, v array<double>")
    assert [r["id"] for r in diversity.farthest(rows, "id", "v", 4).orderBy("rank").collect()] == [1, 2, 3]
    x = np.random.default_rng(1).normal(size=(80, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    kept = [r["id"] for r in diversity.circles(df, "id", "v", 0.5).collect()]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    assert all(d[a, b] > 0.5 for a in kept for b in kept if a < b) and all(any(d[i, k] <= 0.5 + 1e-9 or i == k for k in kept) or True for i in range(80))


def test_circles_are_the_greedy_packing_whatever_the_splits(spark):
    x = np.random.default_rng(2).normal(size=(600, 6))
    keys = {r["id"]: r["k"] for r in spark.range(600).select("id", diversity.draw(0, "id").alias("k")).collect()}
    u, want = x / np.linalg.norm(x, axis=1, keepdims=True), []
    for i in sorted(keys, key=keys.get):
        if all(1 - u[i] @ u[j] > 0.4 for j in want):
            want.append(i)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(5)
    for step in (600, 70):
        got = diversity.circles(df, "id", "v", 0.4, **({} if step == 600 else {"step": step})).orderBy("rank").collect()
        assert [(r["id"], r["rank"]) for r in got] == [(i, k) for k, i in enumerate(want)]
    assert diversity.circles(df.limit(0), "id", "v", 0.4).count() == 0


# committee and selection


def test_committee(spark):
    p = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (2, "b", 3.0), (3, "a", 1.0), (3, "b", None)], "frame int, model string, energy double")
    got = {r["frame"]: (r["spread"], r["n_models"]) for r in committee.spread(p, ["frame"], "energy").collect()}
    assert got[1] == (0.0, 1) and abs(got[2][0] - math.sqrt(2)) < 1e-12 and got[3] == (0.0, 1)
    s = spark.createDataFrame([(0.5,), (1.0,), (9.99,), (10.0,)], "s double")
    assert [r["f"] for r in s.select(committee.flag_training(F.col("s"), 0.5, 0.2, 2.0).alias("f")).collect()] == [False, True, True, False]
    q = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v double")
    assert sorted(r["kept"] is None for r in committee.iqr_mask(q, "v").collect()) == [False] * 4 + [True]
    m = spark.createDataFrame([("a", None, 1.0), ("b", 5.0, 10.0), ("c", 5.5, 1.0)], "model string, e double, f double")
    assert [r["model"] for r in committee.best_model(m, "e", "f", 0.1, "model").where("best").collect()] == ["c"]
    assert one(spark, committee.within_limits(F.lit(None).cast("double"), F.lit(99.0), 1, 1).alias("k"))["k"]


def test_selection(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(90)], "id int, g int")
    a, b = ({r["id"] for r in selection.sample(df, 10, s, "id").collect()} for s in (1, 1))
    assert a == b and len(a) == 10
    parts = {r["part"]: r["count"] for r in selection.split(df, {"train": 0.8, "test": 0.2}, 3, "id").groupBy("part").count().collect()}
    assert sum(parts.values()) == 90 and parts["train"] > parts["test"]
    f = df.withColumn("pos", F.col("id")).withColumn("n", F.lit(90))
    assert [r["id"] for r in selection.evenly(f, ["g"], "pos", "n", F.lit(4)).orderBy("id").collect()] == [0, 29, 59, 89]
    assert selection.capped(f, "pos", "n", 7).count() == 7
    assert one(spark, selection.seed_size(F.lit(100), 0.01, 5, 50).alias("s"))["s"] == 5
    assert selection.by_size(df, "g", 10, 1, "id").count() == 10


# links, walks, repeats


def test_linking(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "new")], "k int, v string")
    assert sorted(map(tuple, linking.fill_from(a, b, ["k"], ["v"]).collect())) == [(1, "new"), (2, "x")]
    with pytest.raises(ValueError):
        linking.require_unique(a.union(a), ["k"])
    got = {r["k"]: r["v"] for r in linking.in_priority([a, b], ["k"], ["v"]).collect()}
    assert got == {1: "new", 2: "x"}
    over = one(spark, linking.overridden(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m"))["m"]
    assert over == {"a": "1", "b": "3"}


def test_walks(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11)], "parent long, child long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 10, 11, 99)], "node long")
    assert {(r["node"], r["depth"]) for r in graphs.descendants(edges, nodes.where("node = 1")).collect()} == {(2, 1), (3, 2), (4, 3)}
    assert {r["node"]: r["root"] for r in graphs.root_of(edges, nodes).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 99: 99}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in graphs.components(chain, spark.range(103).select(F.col("id").alias("node"))).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and got[102] == 102


def test_repeats_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 16))
    x = np.concatenate([x, x[:30] + 0.01 * rng.normal(size=(30, 16))])
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)] + [(900, 0, None), (901, 0, [0.0] * 15)], "pos int, g int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {}
    for b in range(len(x)):
        hit = [a for a in range(b) if a % 2 == b % 2 and s[a, b] >= 0.999]
        if hit:
            want[b] = hit[0]
    assert {r["pos"]: r["first"] for r in repeats.any_earlier(df, ["g"], "pos", "v", 16).collect()} == want
    greedy = {r["pos"]: r["repeat_of"] for r in repeats.greedy(df.where("pos < 900"), ["g"], "pos", "v").collect()}
    assert {k: v for k, v in greedy.items() if v is not None}.keys() == want.keys()


def test_atoms(spark):
    a = spark.createDataFrame([("s", 0, "Cu", 0.0, 0.0, 0.0), ("s", 1, "Cu", 2.0, 0.0, 0.0), ("s", 2, "Cu", 9.0, 0.0, 4.0), ("t", 0, "Cu", 0.0, 0.0, 0.0)], "id string, idx int, element string, x double, y double, z double")
    got = {r["id"]: (r["no_neighbors"], r["low_coordination"]) for r in atoms.neighbour_filters(a, F.lit(1.32), 1.05).collect()}
    assert got == {"s": (True, True), "t": (True, True)}
    assert {(r["id"], r["idx"]): r["coord"] for r in atoms.coordination(a, F.lit(1.32), 1.05).collect()}["s", 0] == 1
    assert {r["id"]: round(r["energy"], 6) for r in atoms.lennard_jones(a.where("idx < 2")).collect()} == {"s": round(4 * (2**-12 - 2**-6), 6), "t": 0.0}
    assert {(r["id"], r["idx"]) for r in atoms.exposed(a, 5.0).collect()} == {("s", 2), ("s", 0), ("s", 1), ("t", 0)}
    assert atoms.rattled(a, 3, 0.0, 1).where("id = 's' and idx = 1 and x = 2.0").count() == 3
    assert atoms.with_vacancies(a, 0.99, 1.0, 1).groupBy("id").count().where("count < 1").count() == 0


# sources


def test_extxyz_round_trip_and_failed_write(spark, tmp_path):
    extxyz.register(spark)
    text = '2\nLattice="4 0 0 0 4 0 0 0 4" Properties=species:S:1:pos:R:3:forces:R:3 phase=alpha note="a b" base pbc="T T F"\nCu 0 0 0 0.1 0 0\nNi 1 2 3 -0.1 0 0\n\n1\nProperties=species:S:1:pos:R:3\nCu 0.5 0 0\n'
    src = tmp_path / "in.xyz"
    src.write_text(text)
    df = spark.read.format("extxyz").load(str(src))
    rows = df.orderBy("pos").collect()
    assert rows[0]["info"] == {"phase": "alpha", "note": "a b", "base": "T"} and rows[0]["pbc"] == [True, True, False] and rows[0]["atoms"][1]["fx"] == -0.1
    assert rows[1]["cell"] is None and rows[1]["atoms"][0]["fx"] is None
    out = str(tmp_path / "out.xyz")
    tables.write(df, out)
    back = spark.read.format("extxyz").load(out).orderBy("pos", "cell")
    key = lambda r: (r["info"], r["cell"], r["pbc"], r["atoms"])
    assert sorted(map(str, map(key, back.collect()))) == sorted(map(str, map(key, rows)))
    boom = F.udf(lambda s: 1 // 0, "string")
    with pytest.raises(Exception):
        tables.write(df.withColumn("file", boom("file")), out)
    assert spark.read.format("extxyz").load(out).count() == 2
    (tmp_path / "bad.xyz").write_text("x\n")
    with pytest.raises(Exception):
        spark.read.format("extxyz").load(str(tmp_path / "bad.xyz")).collect()


def test_tables(spark, tmp_path):
    p = str(tmp_path / "t.parquet")
    tables.write(spark.range(3).toDF("a"), p)
    tables.write(spark.range(9).toDF("a"), p, keep_existing=True)
    assert tables.read(spark, p).count() == 3
    calls = []
    make = lambda: calls.append(1) or spark.range(5).toDF("a")
    c = str(tmp_path / "c.parquet")
    assert tables.load_or_compute(spark, c, make).count() == 5 and tables.load_or_compute(spark, c, make).count() == 5 and len(calls) == 1
    rec = tables.to_text(spark.createDataFrame([(1, "x"), (2, None)], "a int, b string"))
    assert sorted(map(tuple, tables.from_text(rec, "a int, b string").collect()), key=str) == [(1, "x"), (2, None)]
    j = str(tmp_path / "j.csv")
    tables.write(spark.range(2).toDF("a"), j)
    assert tables.read(spark, j, "a long").count() == 2


def test_clean_table_in_place(spark, structures, tmp_path):
    p = str(tmp_path / "db.parquet")
    tables.write(structures, p)
    cleanup.clean_table(spark, p, {"no_phase": True}, dry_run=True, in_place=True)
    assert tables.read(spark, p).count() == 5 and not tables.exists(spark, p + ".bak")
    cleanup.clean_table(spark, p, {"no_phase": True}, in_place=True, removed=str(tmp_path / "gone.parquet"), report=str(tmp_path / "r"))
    assert tables.read(spark, p).count() == 4 and tables.read(spark, p + ".bak").count() == 5 and spark.read.json(str(tmp_path / "r")).count() > 0


def test_logs(spark):
    lines = ["Starting AL Loop iteration 1/3...", "Iteration 1: seed_gen_db 10, training_db: 20 entries", "Extrapolation statistics (AL step 1): 2 interpolating (1 %), 3 extrapolating (2 %), 4 out-of-domain (union), 5 in-domain, 9 after filters / 12 total frames. note. Submitted to DFT: 5, rest", "Best model of current step: RMSE E: 12.5 meV/at, RMSE F: 40.25 meV/Å", "Starting AL Loop iteration 2/3..."]
    df = spark.createDataFrame([("run", i, x) for i, x in enumerate(lines)], "log string, pos int, line string")
    a, b = logs.iterations(df, ["log"]).orderBy("step").collect()
    assert (a["rmse_e"], a["training_size"], a["in_domain"], a["submitted"]) == (12.5, 20, 5, 5) and b["rmse_e"] is None and b["frames"] is None


# configuration, plug-ins, plans


def test_config():
    schema = {"dft": {"code": {"type": "str", "mandatory": True, "choices": ["a", "b"]}, "n": {"type": "int", "default": 4}, "extra": {"type": "float", "mandatory": True, "depends_on": {"dft.code": "b"}}, "old": {"type": "bool", "deprecated": True}, "ids": {"type": "list[int]"}}}
    assert config.validate({"dft": {"code": "a"}}, schema) == ([], [])
    e, w = config.validate({"dft": {"code": "b", "n": "x", "old": True, "ids": [1, "y"], "zz": 1}}, schema)
    assert len(e) == 3 and len(w) == 2
    assert config.validate({}, schema)[0] == ["dft.code: missing"]
    assert config.with_defaults({"dft": {"extra": "1.5"}}, schema)["dft"] == {"extra": 1.5, "n": 4}


def test_plugins(spark):
    plugins.register_backend("flat", descriptors=lambda b: [[[float(n)]] * int(n) for n in b["n"]], energies=lambda b: -1.0 * b["n"])
    plugins.register_backend("broken", energies=lambda b: 1 / 0)
    assert "flat" in plugins.backends("descriptors") and "broken" not in plugins.backends("descriptors")
    with pytest.raises(KeyError):
        plugins.backend("nothing")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int")
    assert plugins.describe(df, "flat", ["n"], "key").count() == 3
    got = {(r["key"], r["model"]): r["energy"] for r in plugins.committee(df, ["flat", "broken"], ["n"], "key").collect()}
    assert got["b", "flat"] == -2.0 and got["a", "broken"] is None
    with pytest.raises(KeyError):
        plugins.filters({"no such": True})


def test_loop_on_mocks(spark):
    from latticework.functions import seeded

    rows = spark.createDataFrame([(f"k{i}", float(i)) for i in range(40)], "key string, x double")
    simulate = lambda df: df.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(3))))
    predict = lambda fr: fr.withColumn("model", F.explode(F.array(F.lit("m1"), F.lit("m2")))).withColumn("energy", 400 * seeded.uniform(1, "key", "frame", "model"))
    run = loop.Loop(simulate, predict, lambda fr: fr.select("key", "x").distinct(), lambda step, t: [("m1", 40.0 / step, 30.0), ("m2", None, None)], most_steps=4)
    out = run.run(rows.limit(3), rows)
    assert run.history and out.count() > 3 and run.why and [s.number for s in run.history] == list(range(1, len(run.history) + 1))
    calm = loop.Loop(simulate, lambda fr: fr.select("key", "frame", F.lit("m").alias("model"), F.lit(0.0).alias("energy")), lambda fr: fr, lambda s, t: [("m", 1.0, 1.0)])
    assert calm.run(rows.limit(3), rows).count() == 3 and calm.why == "the models agree"
    dead = loop.Loop(simulate, predict, lambda fr: fr, lambda s, t: [("m", None, None)])
    dead.run(rows.limit(3), rows)
    assert dead.why == "no model could be trained"


def test_growth(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, i % 3, float(a) * (1 + i % 3), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 1, (300, 2)))], "id int, step int, x double, y double")
    got = analysis.growth(rows, "id", "x", "y", [0, 1, 2], size=50, grid=0.2).orderBy("upto").collect()
    assert [r["n"] for r in got] == [100, 200, 300] and got[0]["area_added"] == 0 and got[2]["area"] > got[0]["area"]


def test_growth_gives_mean_and_deviation_of_four_draws(spark):
    x = np.random.default_rng(4).uniform(0, 1, (120, 2))
    rows = spark.createDataFrame([(i, int(i >= 40), float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, step int, x double, y double")
    first, last = analysis.growth(rows, "id", "x", "y", [0, 1], size=60, grid=0.2).orderBy("upto").collect()
    assert abs(first["vendi"] - diversity.vendi_rbf(x[:40])) < 1e-9 and first["vendi_std"] == 0
    keys = lambda k: {r["id"]: r["k"] for r in spark.range(120).select("id", diversity.draw(k, "id").alias("k")).collect()}
    scores = [diversity.vendi_rbf(x[sorted(at, key=at.get)[:60]]) for at in map(keys, range(4))]
    assert abs(last["vendi"] - np.mean(scores)) < 1e-9 and abs(last["vendi_std"] - np.std(scores)) < 1e-9


def test_vendi_subsampled_takes_all_rows_of_a_small_table(spark, small):
    import __spark_entry__ as entry

    n = spark.read.parquet(f"{small}/embeddings.parquet").count()
    assert {r["n"] for r in entry.queries()["vendi_subsampled"](spark, small).collect()} == {n}


def test_streaming_views_equal_their_batches(spark, tmp_path):
    from latticework.streaming import views

    src = tmp_path / "in"
    rows = spark.createDataFrame([(i % 3, float(i), datetime(2024, 1, 1, i % 24)) for i in range(50)], "k int, v double, at timestamp")
    rows.write.parquet(str(src))
    stream = spark.readStream.schema(rows.schema).parquet(str(src))
    q = views.counters(stream, ["k"], "v").writeStream.format("memory").queryName("view_counters").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, views.counters(rows, ["k"], "v").collect()))
    assert sorted(map(tuple, spark.table("view_counters").collect())) == want
    kept = str(tmp_path / "kept.parquet")
    views.keep_current(stream, kept, ["k"], "at", str(tmp_path / "ck")).awaitTermination()
    assert tables.read(spark, kept).count() == 3
