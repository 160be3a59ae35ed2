from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from latticework.functions.ids import id_key
from latticework.operators import orphans as O

RUNS = "calc_uuid string, atl_id string, recorded_at timestamp_ntz, key string, at int, n int, since string"
STRUCTURES = "atl_id string, recorded_at timestamp_ntz, removed_at timestamp_ntz, month string, until int"


def day(n: int, month: int = 1) -> datetime:
    return datetime(2024, month, n)


def found(spark, runs, structures, heavy=None, bound=O.BROADCAST_ROWS):
    r = spark.createDataFrame([(*x, "x", 1, 2, "y") for x in runs], RUNS)
    s = spark.createDataFrame([(*x, "x", 1) for x in structures], STRUCTURES)
    refs = O.references(r, F.col("calc_uuid"), id_key("atl_id"), F.col("recorded_at"))
    present = O.presence(s, id_key("atl_id"), F.col("recorded_at"), F.col("removed_at"))
    groups = O.counted(refs)
    heavy = O.heavy_keys(groups, least=2) if heavy is None else heavy
    rows, counts = O.orphans(refs, present, O.judged(groups, present, heavy, bound), heavy, bound)
    out = sorted(x["ident"] for x in rows.collect())
    assert len(out) == sum(x["n"] for x in counts.collect())
    return out


def test_moments_and_spelling(spark):
    structures = [("AB-1", day(5), None), ("ab2", day(1), day(10)), ("ab2", day(20), None), ("ab3", day(3), day(3)), (None, day(1), None), ("ab4", None, None)]
    runs = [
        ("early", "ab1", day(4)), ("there", "a b 1", day(5)), ("back", "AB2", day(25)), ("gone", "ab-2", day(10)), ("between", "ab2", day(15)),
        ("never", "zz", day(9)), ("none", "None", day(9)), ("blank", " - ", day(9)), ("null", None, day(9)), ("empty", "ab3", day(3)), ("nowhen", "zz", None), ("started", "ab4", day(9)),
    ]
    want = ["between", "early", "empty", "gone", "never", "started"]
    assert found(spark, runs, structures, heavy=[]) == want
    assert found(spark, runs, structures, heavy=["ab2", "zz"]) == want
    assert found(spark, runs, structures, heavy=["ab2", "zz"], bound=0) == want


def test_a_run_counts_at_its_earliest_row(spark):
    assert found(spark, [("r", "ab1", day(1)), ("r", "ab1", day(9))], [("ab1", day(5), None)]) == ["r"]
    assert found(spark, [("r", "ab1", day(9)), ("r", None, day(9))], [("ab1", day(5), None)]) == []


def test_repeated_rows_and_touching_intervals(spark):
    s = [("ab1", day(1), day(5)), ("ab1", day(1), day(5)), ("ab1", day(5), day(9, 3))]
    assert found(spark, [("a", "ab1", day(5)), ("b", "ab1", day(8, 3)), ("c", "ab1", day(9, 3))], s) == ["c"]


def test_groups_are_decided_whole_where_no_interval_cuts_them(spark):
    r = spark.createDataFrame([("a", "k1", day(2)), ("b", "k1", day(9)), ("c", "k2", day(2)), ("d", "k3", day(1)), ("e", "k3", day(9))], "calc_uuid string, atl_id string, recorded_at timestamp_ntz")
    s = spark.createDataFrame([("k1", day(1), None), ("k2", day(5), None), ("k3", day(5), None)], "atl_id string, recorded_at timestamp_ntz, removed_at timestamp_ntz")
    refs = O.references(r, F.col("calc_uuid"), id_key("atl_id"), F.col("recorded_at"))
    present = O.presence(s, id_key("atl_id"), F.col("recorded_at"), F.col("removed_at"))
    for heavy, bound in (([], 9), (["k1", "k3"], 9), (["k1", "k3"], 0)):
        got = {x["key"]: x["verdict"] for x in O.judged(O.counted(refs), present, heavy, bound).collect()}
        assert got == {"k1": "there", "k2": "absent", "k3": "mixed"}


def test_empty_tables(spark):
    assert found(spark, [], []) == []
    assert found(spark, [("a", "ab1", day(5))], []) == ["a"]
    assert found(spark, [], [("ab1", day(1), None)]) == []


def test_report_counts_why(spark):
    r = spark.createDataFrame([("a", "k1", day(2)), ("b", "k2", day(9)), ("c", "k3", day(1)), ("d", "k3", day(9)), ("e", None, day(1, 2))], "calc_uuid string, atl_id string, recorded_at timestamp_ntz")
    s = spark.createDataFrame([("k1", day(1), None), ("k3", day(5), day(7))], "atl_id string, recorded_at timestamp_ntz, removed_at timestamp_ntz")
    refs = O.references(r, F.col("calc_uuid"), id_key("atl_id"), F.col("recorded_at"))
    present = O.presence(s, id_key("atl_id"), F.col("recorded_at"), F.col("removed_at"))
    out = {x["period"]: x.asDict() for x in O.orphan_report(refs, present, O.orphans(refs, present, O.judged(O.counted(refs), present, []), [])[1], "t").collect()}
    assert out["2024-01"] | {"table_name": "t"} == {"table_name": "t", "period": "2024-01", "n_records": 4, "n_references": 4, "n_orphans": 3, "n_never": 1, "n_later": 1, "n_removed": 1}
    assert out["2024-02"]["n_records"] == 1 and out["2024-02"]["n_references"] == 0
