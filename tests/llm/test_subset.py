from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd

from latticework.llm import subset as P

T = datetime(2024, 1, 1)
ROWS = "atl_id string, phase string, struct_type string, modifications string, recorded_at timestamp_ntz, removed_at timestamp_ntz, vec string, part int"
VECS = "atl_id string, descriptors array<float>, recorded_at timestamp_ntz, phase string"
ASK = "request_id int, phase string, struct_type string, subset_size long"


def select(spark, rows, vecs, ask):
    s = spark.createDataFrame([(i, p, t, None, T, None, "v", 1) for i, p, t in rows], ROWS)
    v = spark.createDataFrame([(i, x, T, "clash") for i, x in vecs], VECS)
    cand = P.candidates(s, v)
    req = P.asked(spark.createDataFrame(ask, ASK))
    out = P.subsets(cand, req)
    return cand, req, out, {r: sorted(x["key"] for x in out.where(f"request_id = {r}").collect()) for r in {a[0] for a in ask if a[0]}}


def test_large_groups_do_not_fill_the_subset(spark):
    rng = np.random.default_rng(0)
    big = rng.normal(size=64) + 0.01 * rng.normal(size=(300, 64))
    rest = rng.normal(size=(12, 64))
    x = np.concatenate([big, rest]).astype(np.float32)
    ids = [f"s{i:03d}" for i in range(len(x))]
    rows = [(i, "Alpha" if n % 2 else "beta", "bulk") for n, i in enumerate(ids)]
    cand, req, out, got = select(spark, rows, list(zip(ids, x.tolist(), strict=True)), [(1, None, None, 13), (2, " ALPHA", None, 4), (3, None, "surface", 5), (4, None, None, 0), (5, "beta", "bulk", 1000), (None, None, None, 3)])
    assert len(got[1]) == 13 and set(got[1]) >= set(ids[300:])
    assert len(got[2]) == 4 and all(int(i[1:]) % 2 for i in got[2])
    assert got[3] == [] and got[4] == [] and len(got[5]) == 156
    report = {r["request_id"]: r for r in P.subset_report(cand, req, out).collect()}
    assert report[1]["n_selected"] == 13 and report[3]["n_available"] == 0 and report[5]["n_available"] == 156


def test_swaps_reach_the_best_sum_on_small_sets():
    import itertools

    rng = np.random.default_rng(1)
    for trial in range(5):
        x = rng.normal(size=(11, 64))
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")
        f = pd.DataFrame({"key": [str(i) for i in range(11)], "phase": "a", "struct_type": "b", "vec": [r.tobytes() for r in x]})
        p = P.Points(f)
        d = np.stack([p.to(i) for i in range(11)])
        total = lambda s: sum(d[a, b] for a, b in itertools.combinations(sorted(s), 2))
        start, _ = P.farthest(p, 4)
        got = P.swaps(p, start, 0.0, passes=50)
        best = max(total(s) for s in itertools.combinations(range(11), 4))
        assert total(got) >= max(total(start), 0.98 * best) - 1e-6


def test_merging_rounds_and_empty_tables(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 64)).astype(np.float32)
    ids = [f"s{i:03d}" for i in range(200)]
    monkeypatch.setattr(P, "LIMIT", 10)
    monkeypatch.setattr(P, "FAN", 2)
    got = select(spark, [(i, None, None) for i in ids], list(zip(ids, x.tolist(), strict=True)), [(1, None, None, 6)])[3]
    assert len(set(got[1])) == 6
    assert select(spark, [], [], [(1, None, None, 6)])[3] == {1: []}
    assert select(spark, [("s1", None, None)], [("s1", x[0].tolist())], [(1, None, None, 6)])[3] == {1: ["s1"]}
    assert select(spark, [("s1", None, None)], [("s1", None)], [(1, None, None, 6)])[3] == {1: []}


def test_distances_among_large_subsets():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5_001, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")
    p = P.Points(pd.DataFrame({"phase": ["a", None, "b"] * 1_667, "struct_type": "t", "vec": [r.tobytes() for r in x]}))
    mean, least = p.among()
    d = p.to(4_000)
    assert np.isfinite(mean).all() and abs(mean[4_000] - d.sum() / 5_000) < 1e-4 and abs(least[4_000] - np.delete(d, 4_000).min()) < 1e-4


def test_every_candidate_has_its_nearest_selected_structure(spark):
    import pytest

    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 64)).astype(np.float32)
    ids = [f"s{i:03d}" for i in range(60)]
    rows = [(i, ("alpha", "beta", None)[n % 3], ("bulk", None)[n % 2]) for n, i in enumerate(ids)]
    cand, req, out, got = select(spark, rows, list(zip(ids, x.tolist(), strict=True)), [(1, None, None, 7), (2, "alpha", None, 3), (3, "gamma", None, 3)])
    told = {(r["request_id"], r["key"]): r for r in P.represented(cand, req, out).collect()}
    assert len(told) == 60 + 20 and {k for (q, k), r in told.items() if q == 1 and r["selected"]} == set(got[1])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = lambda a, b: np.linalg.norm(u[a] - u[b]) + 0.25 * (rows[a][1] != rows[b][1]) + 0.25 * (rows[a][2] != rows[b][2])
    for n, i in enumerate(ids):
        best = min(far(n, ids.index(s)) for s in got[1])
        assert abs(told[1, i]["distance"] - best) < 1e-3
    empty = select(spark, [], [], [(1, None, None, 6)])
    assert P.represented(empty[0], empty[1], empty[2]).collect() == []
    with pytest.raises(ValueError, match="subset"):
        P.asked(spark.createDataFrame([(1, None, None, P.LIMIT + 1)], ASK))
