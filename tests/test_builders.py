from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import atoms, builders as B, checks


@pytest.mark.parametrize("plane", [(1, 0, 0), (1, 1, 0), (1, 1, 1), (2, 1, 0), (2, 1, 1)])
@pytest.mark.parametrize("lattice,per", [("fcc", 4), ("bcc", 2)])
def test_slabs_have_the_density_of_the_bulk(plane, lattice, per):
    a, layers = 3.5, 6
    cell, pos = B.slab(a, lattice, plane, layers, 10.0)
    height = a / np.linalg.norm(plane) * layers
    area = np.linalg.norm(np.cross(cell[0], cell[1]))
    assert len(pos) == round(per * area * height / a**3)
    assert np.linalg.det(cell) > 0 and abs(cell[0, 2]) < 1e-9 and abs(cell[1, 2]) < 1e-9 and abs(cell[2, 2] - height - 10) < 1e-9
    frac = pos @ np.linalg.inv(cell)
    d = frac[:, None] - frac[None]
    d[..., :2] -= np.round(d[..., :2])
    dist = np.sqrt((np.einsum("ijk,kl->ijl", d, cell) ** 2).sum(2)) + np.eye(len(pos)) * 99
    nn = a / np.sqrt(2) if lattice == "fcc" else a * np.sqrt(3) / 2
    assert dist.min() > nn - 1e-6


def test_planes_once():
    got = B.millers(1)
    assert len(got) == 13 and (1, 1, 1) in got and (-1, -1, -1) not in got


def test_fit_and_penalties(spark):
    r = spark.range(1).select(B.replacements_to_fit(F.lit(10), F.lit(2), 0.3, 0.6).alias("a"), B.replacements_to_fit(F.lit(10), F.lit(9), 0.3, 0.6).alias("b"), B.replacements_to_fit(F.lit(10), F.lit(5), 0.3, 0.6).alias("c")).first()
    assert tuple(r) == (1, -3, 0)
    a = spark.createDataFrame([("s", 0, "Cu", 0.0, 0.0, 0.0), ("s", 1, "Cu", 0.0, 0.0, 0.0)], "id string, idx int, element string, x double, y double, z double")
    p = B.penalties(atoms.pairs(a, F.lit(1.3)), 0.7, 1.1).first()
    assert p["repulsion"] == 10.0**6 - 1
    moved = a.withColumn("x", F.col("x") + 1.0)
    assert B.restrained(moved, a, 0.5).first()["restraint"] == 0.5


def test_layers_along_a_plane(spark):
    cell, pos = B.slab(3.6, "fcc", (1, 1, 1), 5, 10.0)
    rows = [("s", i, "Cu", *map(float, p)) for i, p in enumerate(pos)]
    df = spark.createDataFrame(rows, "id string, idx int, element string, x double, y double, z double")
    per = checks.layers(df, checks.surface_normal(cell.tolist(), (0, 0, 1)))
    r = per.first()
    assert r["n_gaps"] >= 4 and abs(r["max_gap"] - r["min_gap"]) < 1e-6
    assert checks.layer_filters(per, 1.0, 100.0).first()["layer_distance"] and checks.layer_filters(per, 3.0, 100.0).first()["duplicate_slabs"]


def test_resampled_paths_and_kernels(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, 1.0, 0.0), (1, 3, 1.0, 3.0)], "id int, i int, x double, y double")
    got = [(round(r["x"], 6), round(r["y"], 6)) for r in checks.resample(p, 5, ["id"], ["i"], "x", "y").orderBy("k").collect()]
    assert got == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (1.0, 2.0), (1.0, 3.0)]
    k = spark.createDataFrame([("a", [[0.0], [1.0]]), ("b", [[0.0], [1.0]]), ("c", [[50.0]])], "id string, m array<array<double>>")
    got = {(r["a"], r["b"]): r["kernel"] for r in checks.average_kernel(k, "id", "m", 1.0).collect()}
    assert abs(got["a", "b"] - 1) < 1e-12 and got["a", "c"] < 1e-12


def test_spheres_and_splits(spark):
    s = checks.sphere(55, 2.5)[["x", "y", "z"]].to_numpy()
    d = np.sqrt(((s[:, None] - s[None]) ** 2).sum(2)) + np.eye(55) * 99
    assert len(s) == 55 and d.min() >= 2.5 - 1e-9
    rows = spark.createDataFrame([(i, i == 0) for i in range(10)], "id int, iso boolean")
    parts = {r["part"]: r["count"] for r in checks.test_split(rows, 0.99, F.col("iso"), 1, "id").groupBy("part").count().collect()}
    assert parts.get("test", 0) + parts.get("neither", 0) == 9
    with pytest.raises(ValueError):
        checks.select(rows, "nothing", 1)
