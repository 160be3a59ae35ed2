"""Operators whose whole answer no SQL gives, against brute force on small inputs."""

from __future__ import annotations

import math
from datetime import datetime
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from latticework import session
from latticework.functions import config, geometry, plugins
from latticework.operators import atoms, builders, checks, diversity, graphs, hulls, latent, repeats, runs
from latticework.plans import generation, maps
from latticework.sources import tables


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


# hulls


def test_convex_hull_and_lines():
    pts = np.random.default_rng(0).normal(size=(80, 2))
    ring = hulls.convex_hull(pts)
    assert geometry.area(ring) > 0 and set(ring) <= set(map(tuple, pts))
    inner = hulls.contains(ring, pts)
    assert all(i or tuple(p) in set(ring) for i, p in zip(inner, pts, strict=True))
    line = np.array([[i, 2.0 * i] for i in range(9)])
    assert hulls.convex_hull(line) == [(0.0, 0.0), (8.0, 16.0)]
    assert hulls.optimised_hull(line)[1] == 0.0 and hulls.optimised_hull(line[:2])[1] == 0.0
    assert hulls.convex_hull(np.zeros((0, 2))) == [] and hulls.concave_hull(np.zeros((3, 2)))[1] == 0.0


def test_concave_hull_starts_at_the_mean_distance_and_goes_down():
    pts = np.random.default_rng(1).uniform(0, 1, (400, 2))
    near = hulls.nearest_distance(pts)
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2)) + np.eye(400) * 9
    assert abs(near - d.min(1).mean()) < 1e-12
    ring, alpha = hulls.concave_hull(pts)
    start = float(np.clip(1.5 / near, 3.0, 8.0))
    assert alpha <= start and 0.8 < geometry.area(ring) < 1.0
    out = (~hulls.contains(ring, pts)).sum() - len(ring)
    assert out <= 0.02 * len(pts)
    again, same = hulls.concave_hull(np.concatenate([pts, pts]), distance=near)
    assert same == alpha and set(again) == set(ring)


def test_optimised_hull_is_no_worse_than_a_grid_of_alphas():
    rng = np.random.default_rng(2)
    a = rng.uniform(0, 2 * np.pi, 250)
    pts = np.column_stack([np.cos(a), np.sin(a)]) * rng.uniform(0.8, 1.0, 250)[:, None] * [3.0, 1.0]
    ring, alpha = hulls.optimised_hull(pts, exact=0.02)
    assert 0 < alpha <= 10 and (~hulls.contains(ring, pts)).sum() <= 0.25 * len(pts) and geometry.area(ring) < geometry.area(hulls.convex_hull(pts)) + 1e-9


def test_dense_leaves():
    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.uniform(0, 10, (100, 2)), rng.normal(5, 0.05, (100, 2))])
    boxes = hulls.leaves(pts, 5)
    dense = hulls.dense_leaves(boxes, width=0.5)
    assert dense and all(b[2] <= 0.5 and b[4] > 0 for b in dense)
    thick = hulls.dense_leaves(boxes, density=50.0)
    assert thick and all(b[4] / b[2] / b[3] >= 50 for b in thick) and hulls.dense_leaves(boxes, width=0.0) == []


def test_bounding_points_are_points_of_the_data_and_weigh_all(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 2))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x] + [(None, 1.0), (float("nan"), 0.0)], "x double, y double")
    got = hulls.extremes(df, "x", "y", 400).collect()
    assert len(got) <= 400 and {(r["x"], r["y"]) for r in got} <= set(map(tuple, x)) and abs(sum(r["n"] for r in got) - 3000) < 1e-6
    assert set(hulls.convex_hull(np.array([(r["x"], r["y"]) for r in got]))) == set(hulls.convex_hull(x))
    assert hulls.extremes(df, "x", "y").count() == 3000 and hulls.extremes(df.limit(0), "x", "y").count() == 0


def test_mean_nearest_distance_of_all_points(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(200, 2)), rng.normal(50, 0.01, size=(50, 2)), [[900.0, 900.0]]])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in np.concatenate([x, x[:20]])], "x double, y double")
    assert abs(hulls.mean_nearest(df, "x", "y") - hulls.nearest_distance(x)) < 1e-9
    monkeypatch.setattr(hulls, "LIMIT", 10)
    assert abs(hulls.mean_nearest(df, "x", "y") - hulls.nearest_distance(x)) < 1e-9
    assert hulls.mean_nearest(df.limit(0), "x", "y") == 0.0


# diversity


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_farthest_points_do_not_depend_on_the_passes(spark, most):
    x = np.random.default_rng(6).integers(0, 4, (60, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, v array<double>")

    def brute(n, start):
        held, out = [np.array(s) for s in start], []
        for _ in range(n):
            d = [min([np.linalg.norm(v - h) for h in held], default=math.inf) for v in x]
            i = int(np.argmax(d))
            if d[i] <= 0:
                break
            out.append(i)
            held.append(x[i])
        return out

    got = [r["id"] for r in diversity.farthest(df, "id", "v", 12, most=most).orderBy("rank").collect()]
    assert got == brute(12, [])
    got = [r["id"] for r in diversity.farthest(df, "id", "v", 5, np.array([[0.0, 0, 0], [3, 3, 3]]), most=most).orderBy("rank").collect()]
    assert got == brute(5, [[0, 0, 0], [3, 3, 3]])
    assert diversity.farthest(df.limit(0), "id", "v", 5).count() == 0


def test_subsamples_have_the_stated_size(spark):
    df = spark.range(20_000).select("id", F.array(F.rand(1), F.rand(2)).alias("v"))
    assert {r["n"] for r in diversity.vendi_subsampled(df, "id", "v", size=100, rounds=4).collect()} == {100}


def test_kernel_width_takes_all_rows_where_there_are_fewer(spark):
    x = np.random.default_rng(7).normal(size=(30, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))[np.triu_indices(30, 1)]
    r = builders.kernel_width(df, "id", "v").first()
    assert r["n_pairs"] == 435 and abs(r["median"] - np.median(d)) < 1e-9
    with pytest.raises(ValueError, match="sample"):
        builders.kernel_width(df, "id", "v", 100_000)


# graphs, repeats, fragments


def test_components_of_small_and_large_graphs_agree(spark, monkeypatch):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    e = spark.createDataFrame(edges, "a long, b long")
    n = spark.range(150).select(F.col("id").alias("node"))
    small = {r["node"]: r["component"] for r in graphs.components(e, n).collect()}
    monkeypatch.setattr(graphs, "SMALL", 0)
    assert {r["node"]: r["component"] for r in graphs.components(e, n).collect()} == small and len(small) == 150 and small[140] == 100


def test_cycles_raise_and_do_not_end_early(spark):
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "parent long, child long")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    with pytest.raises(ValueError, match="cycle"):
        graphs.descendants(ring, nodes.where("node = 1"), most_levels=5)
    with pytest.raises(ValueError, match="cycle"):
        graphs.root_of(ring, nodes, most_rounds=5)


def test_repeats_in_hot_groups_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(20, 8))
    x = np.concatenate([np.repeat(base[:1], 60, 0), base[rng.integers(0, 20, 60)] + 0.3 * rng.normal(size=(60, 8))])
    order = rng.permutation(len(x))
    g = ["hot" if i % 3 else None for i in range(len(x))]
    df = spark.createDataFrame([(int(o), g[i], x[i].tolist()) for i, o in enumerate(order)], "pos int, g string, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for b in range(len(x)):
        hit = [int(order[a]) for a in range(len(x)) if g[a] == g[b] and order[a] < order[b] and u[a] @ u[b] >= 0.9 - 1e-12]
        if hit:
            want[int(order[b])] = min(hit)
    assert {r["pos"]: r["first"] for r in repeats.any_earlier(df, ["g"], "pos", "v", 8, 0.9).collect()} == want
    monkeypatch.setattr(repeats, "BLOCK", 3)
    monkeypatch.setattr(repeats, "BUCKET", 5)
    assert {r["pos"]: r["first"] for r in repeats.any_earlier(df, ["g"], "pos", "v", 8, 0.9).collect()} == want
    assert repeats.any_earlier(df.limit(0), ["g"], "pos", "v", 8).count() == 0


def test_fragments_of_each_structure(spark):
    rng = np.random.default_rng(10)
    rows, want = [], {}
    for s in range(25):
        n = int(rng.integers(1, 9))
        p = rng.uniform(0, 4, (n, 3))
        rows += [(s, i, *map(float, q)) for i, q in enumerate(p)]
        near = np.linalg.norm(p[:, None] - p[None], axis=2) <= 1.1 * 2.0
        lab = list(range(n))
        for _ in range(n):
            lab = [min(lab[j] for j in range(n) if near[i, j]) for i in range(n)]
        want[s] = (len(set(lab)), max(lab.count(c) for c in lab) / n)
    df = spark.createDataFrame(rows, "id int, idx int, x double, y double, z double")
    assert {r["id"]: (r["n_fragments"], r["largest_fraction"]) for r in checks.fragments(df, F.lit(1.0)).collect()} == want
    assert checks.fragments(df.limit(0), F.lit(1.0)).count() == 0


# maps, generation, clusters


def test_principal_axes_against_numpy(spark):
    x = np.random.default_rng(11).normal(size=(200, 5)) * [5, 3, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 5)], "id int, v array<double>")
    a = maps.fit(df, "v", 5)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(np.abs(a.axes @ vectors[:, ::-1][:, :2]), np.eye(2), atol=1e-8) and abs(a.share - values[-2:].sum() / values.sum()) < 1e-9
    cx, _ = maps.placed("v", a)
    got = {r["id"]: r["c"] for r in df.where("id < 900").select("id", cx.alias("c")).collect()}
    assert all(abs(got[i] - (x[i] - a.mean) @ a.axes[0]) < 1e-9 for i in got)
    rows, _, ring = maps.build(df.where("id < 900"), "v", 5)
    told = maps.evolution(rows.withColumn("step", F.col("id") % 2), "step", ring).collect()
    assert len(ring) > 2 and sum(r["n"] for r in told) == 200 and all(r["outside"] <= r["n"] for r in told)
    assert maps.fit(df.limit(0), "v", 5).share == 0.0


def test_wulff_shapes():
    p = checks.wulff(13, 2.5)[["x", "y", "z"]].to_numpy()
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) + np.eye(13) * 9
    assert len(p) == 13 and abs(d.min() - 2.5) < 1e-9 and np.allclose(p.sum(0), 0) and np.allclose(np.sort(np.linalg.norm(p, axis=1))[1:], 2.5)
    assert len(checks.wulff(1, 2.5)) == 1 and np.allclose(checks.wulff(201, 2.5)[["x", "y", "z"]].sum(), 0)


def test_clusters_of_one_size_are_built_once_and_stay_whole_rows(spark, small):
    checks._wulff.cache_clear()
    assert checks._wulff(20, 2.5) is checks._wulff(20, 2.5) and checks._wulff.cache_info().misses == 1
    req = spark.createDataFrame([(i, "Cu", 13 + i % 3) for i in range(30)], "id int, element string, n int")
    got = checks.clusters(spark, req, 2.5, "wulff").orderBy("id", "idx").toPandas()
    for i, g in got.groupby("id"):
        assert np.allclose(g[["x", "y", "z"]], checks.wulff(13 + i % 3, 2.5)[["x", "y", "z"]]) and g["idx"].tolist() == list(range(13 + i % 3))
    balls = checks.clusters(spark, req.where("id = 7"), 2.5).orderBy("idx").toPandas()
    assert np.allclose(balls[["x", "y", "z"]], checks.sphere(14, 2.5, 7)[["x", "y", "z"]])
    plan = entry.queries()["wulff_clusters"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_generation_stages(spark):
    rows = [(i, f"p{i % 2}", k, "Ni" if k else "Ti", 1.5 * k, 0.0, 0.0) for i in range(6) for k in range(2)]
    proto = spark.createDataFrame(rows, "id int, phase string, idx int, element string, x double, y double, z double")
    s = generation.Settings(repeats=2, most_atoms=16, copies=2, vacancies=(0.1, 0.2), whole=None, per_phase=4, adsorbate=("O", 1.5, 1.0))
    held, report = generation.generate(proto, F.lit(3.0), F.lit(1.3), s)
    n = {(r["stage"], r["phase"]): r["n"] for r in report.collect()}
    assert n["bulk", "p0"] == 6 and n["limit", "p1"] == 4 and n["adsorbates", "p0"] == 4
    assert held.where("element = 'O'").groupBy("id").count().where("count != 1").count() == 0
    far = spark.createDataFrame([(1, k, "Ni", 9.0 * k, 0.0, 0.0) for k in range(4)] + [(2, k, "Ni", 1.0 * k, 0.0, 0.0) for k in range(4)], "id int, idx int, element string, x double, y double, z double")
    assert {r["id"] for r in generation.vacancies(far, F.lit(1.0), 0.0, 0.1, 1, 0.95).collect()} == {2}
    assert {r["idx"] for r in generation.symmetrical(far).where("id = 2 and paired").collect()} == {0, 1, 2, 3}


@pytest.mark.parametrize("whole", [None, 0.9])
def test_generation_stores_names_and_only_the_atoms_that_are_left(spark, monkeypatch, whole):
    rows = [(i, f"p{i % 2}", k, "Ni" if k else "Ti", 1.5 * k, 0.3 * i, 0.0) for i in range(20) for k in range(1 + i % 3)]
    proto = spark.createDataFrame(rows, "id int, phase string, idx int, element string, x double, y double, z double")
    s = generation.Settings(repeats=2, most_atoms=16, replace=("Ni", "Cu", 1), copies=2, vacancies=(0.1, 0.3), whole=whole, per_phase=3, adsorbate=("O", 1.5, 1.0), seed=5)
    size, radius, key = F.lit(2.6), F.lit(1.2), F.concat_ws("-", F.col("id").cast("string"), F.col("copy").cast("string"))
    bulk = generation.bulk_variants(proto.drop("phase"), size, s).join(proto.select("id", "phase").distinct(), "id").withColumn("id", key).drop("copy")
    names = bulk.select("id", "phase").distinct()
    left = generation.vacancies(bulk.drop("phase"), radius, 0.1, 0.3, 5, whole).join(names, "id")
    some = generation.capped(left, "phase", 3, 5).drop("phase")
    want = checks.with_adsorbate(some, atoms.exposed(some, 1.0), "O", 1.5, 5).join(names, "id")
    counts = {(n, r["phase"]): r["n"] for n, d in (("bulk", bulk), ("vacancies", left), ("limit", want), ("adsorbates", want)) for r in d.groupBy("phase").agg(F.countDistinct("id").alias("n")).collect()}
    stored, write = [], session.materialise
    monkeypatch.setattr(session, "materialise", lambda df, name="stage": stored.append(write(df, name)) or stored[-1])
    held, report = generation.generate(proto, size, radius, s)
    cols = ["id", "phase", "idx", "element", "x", "y", "z"]
    assert sorted(map(tuple, held.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert {(r["stage"], r["phase"]): r["n"] for r in report.collect()} == counts
    assert all(df.count() <= held.count() for df in stored if "x" in df.columns)


def test_vendi_score_of_a_plane_without_eigenvalues(monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1_000, 2)), 0.1 * rng.normal(size=(500, 2)) + 3, rng.uniform(-4, 4, (100, 2)), np.full((20, 2), 0.5)])
    for sigma in (0.01, 0.03):
        monkeypatch.setattr(diversity, "PLANE", len(x))
        want = diversity.vendi_rbf(x, sigma)
        monkeypatch.setattr(diversity, "PLANE", 0)
        monkeypatch.setattr(diversity.np.linalg, "eigvalsh", None)
        assert abs(diversity.vendi_rbf(x, sigma) / want - 1) < 1e-8
        monkeypatch.undo()
    wide = x[:200]
    assert diversity._vendi_plane(wide, 50.0) is None and diversity.vendi_rbf(wide, 50.0) >= 1


def test_meshes_of_oblique_cells(spark):
    cell = F.array(*[F.lit(float(x)) for x in (2, 0, 0, -1, math.sqrt(3), 0, 0, 0, 4)])
    r = one(spark, atoms.reciprocal_lengths(cell).alias("r"), atoms.kmesh(atoms.reciprocal_lengths(cell), 0.2, F.lit(2)).alias("k"))
    assert np.allclose(r["r"], [2 * math.pi / math.sqrt(3)] * 2 + [math.pi / 2]) and r["k"] == [18, 18, 1]
    flat = F.array(*[F.lit(0.0)] * 9)
    assert one(spark, atoms.reciprocal_lengths(flat).alias("r"))["r"] == [None] * 3


# rules on runs


def test_small_rules(spark):
    m = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    r = one(
        spark, runs.renamed(m("a", "1", "b", "2"), {"a": "b"}).alias("renamed"), runs.with_info(m("a", "1"), m("a", "9", "c", "3")).alias("info"), runs.without(m("stress", "1", "x", "2"), "stress").alias("bare"),
        runs.stress(F.lit(None).cast("array<double>"), F.array(*[F.lit(1.0)] * 6)).alias("stress"), runs.stress(F.array(F.lit(1.0)), F.lit(None).cast("array<double>")).alias("none"),
        runs.step_number(F.lit(None).cast("int"), F.lit(4)).alias("step"), runs.state_class(F.lit(" Killed")).alias("state"), runs.state_class(F.lit(None).cast("string")).alias("unknown"),
        runs.scheduler_options(F.lit(24), F.lit(None).cast("int")).alias("one"), runs.scheduler_options(F.lit(12), F.lit(30)).alias("more"), runs.scheduler_options(F.lit(16), F.lit(3)).alias("other"),
    )
    assert r["renamed"] == {"b": "1"} and r["info"] == {"a": "9", "c": "3"} and r["bare"] == {"x": "2"} and r["stress"] == [1.0] * 6 and r["none"] is None
    assert (r["step"], r["state"], r["unknown"], tuple(r["one"]), tuple(r["more"]), r["other"]) == (5, "danger", "unknown", (1, 24), (3, 12), None)


def test_ids_and_diagrams_are_refused_with_an_error(spark):
    with pytest.raises(ValueError, match="repeated"):
        runs.require_ids(spark.createDataFrame([("a",), ("a",), ("b",)], "k string"), "k")
    with pytest.raises(ValueError, match="None"):
        runs.require_ids(spark.createDataFrame([("a",), (None,)], "k string"), "k")
    runs.require_ids(spark.createDataFrame([], "k string"), "k")
    with pytest.raises(Exception, match="no diagram"):
        one(spark, runs.diagram_kind(F.lit(4)))


def test_best_starts_and_views(spark):
    rows = spark.createDataFrame([(1, 1, None, 0.1), (1, 2, True, None), (1, 3, True, 0.5), (1, 4, False, 0.0), (2, 1, False, 0.3)], "t int, s int, ok boolean, d double")
    got = {r["t"]: r["s"] for r in runs.best_start(rows, ["t"], runs.feasible_first(F.col("ok"), F.col("d"), F.col("s"))).collect()}
    assert got == {1: 3, 2: 1}
    c = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "t int, tx double, ty double")
    p = spark.createDataFrame([("b", 0.5, 0.0), ("a", 0.0, 0.5), ("c", 3.0, 0.0)], "k string, x double, y double")
    assert [tuple(r) for r in latent.nearest_within(c, p, "t", "k", 1.0).collect()] == [(1, "a", 0.5)]
    m = spark.createDataFrame([("m", 100, 1.0), ("m", 200, 0.75), ("m", 300, 0.25), ("n", 100, 1.0)], "model string, t int, solid double")
    assert {r["model"]: r["melting"] for r in runs.melting_point(m, ["model"], "t", "solid").collect()} == {"m": 250.0, "n": None}


def test_settings_text_and_checked_calculators():
    text = config.recommendation([("dft", "encut", 400.0), ("dft", "sigma", 0.1), ("md", "steps", 5.0)])
    assert config.parse_toml(text) == {"dft": {"encut": 400.0, "sigma": 0.1}, "md": {"steps": 5.0}} and config.recommendation([]) == ""
    f = plugins.checked(lambda b: b["e"], 10.0)
    assert f(pd.DataFrame({"e": [-5.0], "n_atoms": [1]})).tolist() == [-5.0]
    for bad in (-500.0, None):
        with pytest.raises(ValueError, match="unphysical"):
            f(pd.DataFrame({"e": [bad], "n_atoms": [2]}))
    with pytest.raises(ValueError, match="backend offers"):
        plugins.register_backend("odd", colour=lambda b: b)


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *a: None)
    fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(ValueError, match="shared folder"):
        session.scratch_root(fake)


def test_a_late_older_row_does_not_replace_a_newer_one(spark, tmp_path):
    from latticework.streaming import views

    src, kept = tmp_path / "in", str(tmp_path / "kept.parquet")
    form = "k int, v string, at timestamp"
    for day, v in ((2, "new"), (1, "old"), (3, "newest")):
        spark.createDataFrame([(1, v, datetime(2024, 1, day))], form).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(form).parquet(str(src))
        views.keep_current(stream, kept, ["k"], "at", str(tmp_path / "ck")).awaitTermination()
        if day == 1:
            assert [r["v"] for r in tables.read(spark, kept).collect()] == ["new"]
    assert [r["v"] for r in tables.read(spark, kept).collect()] == ["newest"]
