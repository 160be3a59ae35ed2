from __future__ import annotations

import itertools

import numpy as np

from latticework.llm import overlap as V

MEMBERS = "atl_id string, split_name string, source string, key string, cls int"
SETS = "atl_id string, latent_space array<array<float>>, n int, pts string, recorded_at timestamp_ntz"


def run(spark, members, sets):
    m = spark.createDataFrame([(*x, "x", 1) for x in members], MEMBERS)
    s = spark.createDataFrame([(*x, 1, "y", None) for x in sets], SETS)
    return sorted(tuple(r) for r in V.overlaps(m, s).select("split", "train_key", "eval_key").collect()), m


def cloud(seed, n=9):
    return np.random.default_rng(seed).normal(size=(n, 2)).astype(np.float32)


def test_same_id_spellings_and_near_sets(spark):
    a = cloud(1)
    b = (a + np.random.default_rng(2).uniform(-0.0049, 0.0049, a.shape))[::-1]
    far = a + np.float32(0.02)
    members = [("AA-1", " Train", None), ("aa1", "train", "s"), ("bb2", "TEST ", "s"), ("cc3", "valid", None), ("aa 1", "valid", "s"), ("dd4", "pool", None), (None, "test", None), ("nan", "train", None), ("aa1", None, None)]
    sets = [("aa1", a.tolist()), ("AA1", a.tolist()), ("BB2", b.tolist()), ("cc3", far.tolist()), ("dd4", a.tolist())]
    got, m = run(spark, members, sets)
    assert got == [("test", "aa1", "bb2"), ("valid", "aa1", "aa1")]
    report = {(r["split_name"], r["source"]): r for r in V.overlap_report(V.overlaps(m, spark.createDataFrame([(*x, 1, "y", None) for x in sets], SETS)), m).collect()}
    assert report["test", "s"]["n_near_same"] == 1 and report["valid", "s"]["n_same_id"] == 1 and report["valid", "unknown"]["n_overlapping"] == 0


def test_unusable_sets_and_empty_tables(spark):
    a = cloud(3)
    short, bad, hole = a[:7].tolist(), a.tolist(), a.tolist()
    bad[0] = [float("nan"), 0.0]
    hole[0] = None
    members = [("t1", "train", None), ("e1", "test", None)]
    for x in (short, bad, hole, None, [], [[1.0]] * 9):
        assert run(spark, members, [("t1", x), ("e1", x)])[0] == []
    assert run(spark, [], [])[0] == []
    assert run(spark, members, [])[0] == []
    assert run(spark, [], [("t1", a.tolist())])[0] == []


def test_copies_meet_without_pairs_in_buckets(spark):
    a = cloud(4).tolist()
    members = [(f"t{i}", "train", None) for i in range(30)] + [(f"e{i}", "test", None) for i in range(20)]
    got, _ = run(spark, members, [(m[0], a) for m in members])
    assert got == sorted(("test", f"t{i}", f"e{j}") for i in range(30) for j in range(20))


def test_members_of_large_classes_come_in_parts(spark, monkeypatch):
    a, b = cloud(4), cloud(4)
    b[0, 0] += 0.004
    members = [(f"t{i}", "train", None) for i in range(9)] + [(f"e{i}", "test", None) for i in range(7)] + [(f"v{i}", "valid", None) for i in range(5)]
    points = [(m[0], (a if i % 2 else b).tolist()) for i, m in enumerate(members)]
    whole = run(spark, members, points)[0]
    monkeypatch.setattr(V, "SALT_EVERY", 2)
    assert run(spark, members, points)[0] == whole and len(whole) == 9 * 12


def test_near_same_needs_a_pairing():
    a = np.array([[0, 0], [0.004, 0], [5, 5]], float)
    b = np.array([[0.002, 0], [0.1, 0], [5, 5]], float)
    c = np.array([[0.008, 0], [0.003, 0], [5, 5.004]], float)
    assert not V.near_same(a[None], b[None])[0]
    assert V.near_same(a[None], c[None])[0]
    assert V.pairing([np.array([0, 1]), np.array([0])]) and not V.pairing([np.array([0]), np.array([0])])


def test_pairing_against_all_permutations():
    rng = np.random.default_rng(0)
    for _ in range(200):
        ok = rng.random((4, 4)) < 0.4
        want = any(all(ok[i, p[i]] for i in range(4)) for p in itertools.permutations(range(4)))
        assert V.pairing([np.flatnonzero(r) for r in ok]) == want


def test_near_same_sets_keep_the_promised_similarity():
    rng = np.random.default_rng(5)
    for n in (8, 64):
        a = rng.normal(size=(300, n, 2))
        b = a + rng.choice([-0.005, 0.005], a.shape)
        assert (V.jaccard(a, b) >= V.JACCARD).all()
        flat = lambda x: V.signatures(x.reshape(-1, 2), np.repeat(np.arange(300), n), 300)
        same = (flat(a) == flat(b)).reshape(300, V.ROWS, V.BANDS).all(1)
        assert same.any(1).all()


def test_large_sets_are_compared_too():
    a = np.random.default_rng(6).normal(size=(1, 1500, 2)) * 50
    assert V.near_same(a, a[:, ::-1] + 0.004)[0] and not V.near_same(a, a + 0.006)[0]
