from __future__ import annotations

import os

import pytest

from latticework.llm import mixing as M
from latticework.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")
DOCS = "doc_id long, source string, text string, uses int, pattern string, h int"
ASK = "source string, target_share double, max_repeats int"


def mix(spark, docs, ask, **kw):
    d = spark.createDataFrame([(*x, 1, "p", 2) for x in docs], DOCS)
    out, told = M.mix(d, spark.createDataFrame(ask, ASK), **kw)
    return {r["doc_id"]: r for r in out.collect()}, {r["source"]: r for r in told.collect()}


def docs(n, source, start=0):
    return [(start + i, source, f"word {source} {i} " * 3) for i in range(n)]


def test_shares_caps_and_a_missing_source(spark):
    got, told = mix(spark, docs(200, "Big ") + docs(20, "small", 1000) + docs(5, "other", 5000), [("big", 0.7, 1), ("small", 0.28, 4), ("none", 0.02, 3)])
    assert told["none"]["tokens_used"] == 0 and told["none"]["shortfall_tokens"] == told["none"]["quota_tokens"] > 0
    assert abs(told["big"]["share_reached"] - 0.7 / 0.98) < 0.01 and abs(told["small"]["share_reached"] - 0.28 / 0.98) < 0.01
    assert max(r["uses"] for r in got.values() if r["source"] == "small") <= 4 and max(r["uses"] for r in got.values() if r["source"] == "big") == 1
    assert all(i < 5000 for i in got)
    again = mix(spark, docs(200, "Big ") + docs(20, "small", 1000), [("big", 0.7, 1), ("small", 0.28, 4), ("none", 0.02, 3)])[0]
    assert {i: r["uses"] for i, r in again.items()} == {i: r["uses"] for i, r in got.items()}


def test_texts_in_several_sources_are_used_at_most_as_often_as_all_allow(spark):
    both = [(i, s, f"shared text number {i % 50}") for i, s in enumerate(["a"] * 50 + ["b"] * 50)]
    got, told = mix(spark, both + docs(50, "a", 200), [("a", 0.5, 2), ("b", 0.5, 3)])
    per = {}
    for i, r in got.items():
        if i < 100:
            per[i % 50] = per.get(i % 50, 0) + r["uses"]
    assert max(per.values()) <= 2
    assert abs(told["a"]["share_reached"] - 0.5) < 0.05


def test_repeats_within_a_source_nulls_and_empty_tables(spark):
    rows = [(5, "a", "same text"), (3, "a", "same text"), (9, "a", None), (10, "a", ""), (11, None, "x"), (12, "b", "y")]
    got, told = mix(spark, rows, [("a", 1.0, None), ("a", 0.5, 7), (None, 0.5, 1), ("z", None, 2)])
    assert set(got) == {3} and got[3]["uses"] == 1 and told["a"]["documents_there"] == 1
    assert mix(spark, [], [("a", 1.0, 1)])[0] == {}
    assert mix(spark, rows, []) == ({}, {})


def test_a_stated_total_and_the_route():
    want = {"a": (0.5, 2), "b": (0.5, 1)}
    counts = {("a",): 100, ("b",): 300, ("a", "b"): 50}
    assert M.best_total(counts, want) == 2 * 200 + 2 * 50
    sent, short = M.route(counts, want, 400)
    assert sum(n for (p, s), n in sent.items() if s == "a") == 200 and not any(short.values())
    assert M.route(counts, want, 2000)[1]["b"] > 0


def test_how_far_a_small_source_holds_the_total_back_is_stated_and_told(spark):
    rows = docs(200, "big") + docs(2, "small", 1000)
    ask = [("big", 0.7, 1), ("small", 0.3, 1)]
    _, free = mix(spark, rows, ask)
    _, held = mix(spark, rows, ask, least=0.0)
    assert not free["small"]["holds_total"] and free["small"]["shortfall_tokens"] > 0 and free["big"]["documents_used"] == 200
    assert held["small"]["holds_total"] and held["small"]["shortfall_tokens"] == 0 and held["big"]["documents_used"] < 10
