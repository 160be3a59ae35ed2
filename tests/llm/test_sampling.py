from __future__ import annotations

from collections import Counter
from datetime import datetime

from latticework.llm import sampling as S
from latticework.llm.flow import Flow

ROWS = "atl_id string, phase string, struct_type string, modifications string, recorded_at timestamp_ntz, removed_at timestamp_ntz, key string, quota int, bucket int"
ASK = "request_id int, sample_size long, field_name string, category string, target_share double, min_rows long"
T = datetime(2024, 1, 1)


def draw(spark, rows, ask, seed=11):
    s = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], ROWS)
    sample, report = S.draw(s, spark.createDataFrame(ask, ASK), seed)
    return sample.collect(), {(r["request_id"], r["category"]): r for r in report.collect()}


def many(n, phase, kind="bulk", mods="[]", tag=""):
    return [(f"{tag or phase}{kind}{i}", phase, kind, mods, T, None) for i in range(n)]


def test_shares_minimum_and_shortfall(spark):
    rows = many(300, "Alpha ") + many(80, "beta") + many(3, "rare_one") + many(40, None, tag="x")
    ask = [(1, 100, "phase", "alpha", 0.5, 5), (1, 100, "phase", "BETA", 0.3, 5), (1, 100, "phase", "rare one", 0.2, 5)]
    got, report = draw(spark, rows, ask)
    assert len(got) == 100 == len({r["key"] for r in got})
    n = Counter(r["phase"] for r in got)
    assert n["rare_one"] == 3 and n["alpha"] >= 50 and n["beta"] >= 30
    r = report[1, "rare_one"]
    assert (r["shortfall_rows"], r["minimum_shortfall_rows"], r["outcome"]) == (17, 2, "too few rows")
    assert report[1, "alpha"]["outcome"] == "met"
    assert {r["key"] for r in draw(spark, rows, ask)[0]} == {r["key"] for r in got}
    assert {r["key"] for r in draw(spark, rows, ask, 12)[0]} != {r["key"] for r in got}


def test_overlapping_modifications(spark):
    rows = many(50, "a", mods='["perturb"]', tag="p") + many(50, "a", mods='["PERTURB", "vacancy"]', tag="b") + many(50, "a", tag="n") + many(5, "a", mods="[", tag="q")
    got, report = draw(spark, rows, [(3, 40, "modifications", "perturb", 0.9, 4), (3, 40, "modifications", "vacancy", 0.9, 4)])
    mods = [set(r["modifications"]) for r in got]
    assert len(got) == 40 and sum("vacancy" in m for m in mods) == 36 and sum("perturb" in m for m in mods) >= 36
    assert report[3, "vacancy"]["outcome"] == "met"


def test_current_rows_only(spark):
    rows = [("A-1", "alpha", "bulk", None, T, None), ("a1", "beta", "bulk", None, datetime(2024, 1, 2), None), ("b2", "alpha", "bulk", None, T, T), ("none", "alpha", "bulk", None, T, None), (None, "alpha", None, None, T, None), ("c3", "alpha", None, "['vacancy']", None, None)]
    got, _ = draw(spark, rows, [(1, 10, "phase", "alpha", 1.0, 1), (2, 10, "modifications", "vacancy", 1.0, 1)])
    assert {r["key"] for r in got if r["request_id"] == 1 and r["phase"] == "alpha"} == {"c3"}
    assert {r["key"] for r in got} == {"a1", "c3"}


def test_empty_tables_and_empty_requests(spark):
    assert draw(spark, [], [(1, 10, "phase", "alpha", 1.0, 2)])[0] == []
    assert draw(spark, many(5, "alpha"), []) == ([], {})
    got, report = draw(spark, many(5, "alpha"), [(1, None, "phase", "alpha", None, None), (None, 5, "phase", "alpha", 1.0, 1), (2, 3, "colour", "alpha", 1.0, 1), (3, 9, "phase", "alpha", 1.0, 1)])
    assert len(got) == 5 and {r["request_id"] for r in got} == {3}
    assert report[3, "alpha"]["shortfall_rows"] == 4


def test_flow_is_the_cheapest():
    net = Flow()
    a = net.arc("s", "a", 5, 1)
    b = net.arc("s", "b", 5, 3)
    c = net.arc("a", "t", 4)
    net.arc("a", "b", 9, 1)
    net.arc("b", "t", 4)
    assert net.run("s", "t", 7) == 7
    assert (net.sent(a), net.sent(b), net.sent(c)) == (5, 2, 4)


def test_exchange_reaches_the_best_small_plan():
    import itertools

    q = {"size": 6, "field": "modifications", "cats": {"x": (0.5, 1), "y": (0.5, 1), "z": (0.5, 1)}}
    counts = {("x",): 2, ("y",): 2, ("z",): 1, ("x", "y"): 3, ("y", "z"): 2, (): 4}
    made = S.plan(q, counts)
    got = made.quota
    miss = lambda n: sum(abs(sum(k for p, k in n.items() if c in p) - 3) for c in "xyz")
    best = min(miss(dict(zip(counts, ks, strict=True))) for ks in itertools.product(*[range(n + 1) for n in counts.values()]) if sum(ks) == 6)
    assert sum(got.values()) == 6 and miss(got) == best
    assert made.gap >= 0 and sum(made.short.values()) == sum(max(0, 3 - sum(k for p, k in got.items() if c in p)) for c in "xyz")


def test_slack_arcs_are_the_shortfall_and_the_gap_is_proven():
    q = {"size": 40, "field": "modifications", "cats": {"a": (0.5, 4), "b": (0.5, 30), "c": (0.2, 0)}}
    single = S.plan(q, {("a",): 50, ("b",): 10, (): 100})
    assert single.short == {"a": 0, "b": 20, "c": 8} and single.floor_short == {"a": 0, "b": 20, "c": 0}
    assert single.quota == {("a",): 30, ("b",): 10, (): 0} and sum(S.plan(q, {("a",): 50, ("b",): 10, (): 100}, fill=False).quota.values()) == 30
    both = S.plan(q, {("a", "b"): 100, ("c",): 3, (): 9})
    assert both.quota[("a", "b")] >= 30 and both.short["c"] == 5 and both.gap == 0
    wide = {tuple(c for j, c in enumerate("abcdefgh") if i >> j & 1): 3 + i % 5 for i in range(256)}
    many = S.plan({"size": 100, "field": "modifications", "cats": {c: (0.3, 2) for c in "abcdefgh"}}, wide)
    assert sum(many.quota.values()) == 100 and many.gap == 0 and not any(many.short.values())
