"""References to records that do not exist at the moment the reference is made.

Method: a skew-aware split. References are counted per key and period first, with the first and last
moment (partial aggregation: a hot key leaves each map task as one row per period). These groups,
not the records, meet the presence intervals: a group that no interval touches is all orphans, one that
an interval covers has none, and only the records of the others (an interval begins or ends within
the group's moments) are looked at one by one. Keys that hold many references are few by arithmetic (at
most ``total / threshold``); their intervals are broadcast after their number has been checked, and beyond the
bound they are joined per key and period, which splits a key over as many tasks as it has periods. All
other keys go through a shuffled join. The counts of both sides are put together.

Presence of a key is kept as disjoint half-open intervals [from, to), merged first within a
month and then over all, so that a key indexed very often shrinks before it meets in one task.

Defined results: references with a null time are left out (their moment is unknown); references
that are no id are no references; targets with a null start or a null key never exist; a target
removed at or before its start never exists; empty inputs give empty results; repeated rows
count once; other columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: "Never removed", as a time.
FOREVER = "9999-12-31 00:00:00"
HEAVY_LEAST = 10_000
HEAVY_KEYS = 1_000
BROADCAST_ROWS = 100_000


def _merge(rows: DataFrame, *by: Column | str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("since", "until")
    before = F.max("until").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.withColumn("fresh", F.coalesce((before < F.col("since")).cast("int"), F.lit(0)))
    numbered = starts.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "island").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("island")


def presence(targets: DataFrame, key: Column, since: Column, until: Column) -> DataFrame:
    """(key, since, until): the disjoint intervals in which each key exists."""
    rows = targets.select(key.alias("key"), since.alias("since"), F.coalesce(until, F.lit(FOREVER).cast("timestamp_ntz")).alias("until"))
    rows = rows.where("key is not null and since < until").groupBy("key", "since").agg(F.max("until").alias("until"))
    monthly = _merge(rows.withColumn("month", F.date_format("since", "yyyy-MM")), "key", "month").drop("month")
    return _merge(monthly, "key")


def references(rows: DataFrame, ident: Column, key: Column, at: Column) -> DataFrame:
    """(ident, key, at, period): one row per record, as of its earliest row; key is null where that is no reference.

    Of equally early rows a row with a key goes before one without, then the smaller key.
    """
    first = F.min(F.struct(at.alias("at"), key.isNull().alias("none"), key.alias("key")))
    one = rows.where(ident.isNotNull() & at.isNotNull()).groupBy(ident.alias("ident")).agg(first.alias("f"))
    return one.select("ident", F.col("f.key").alias("key"), F.col("f.at").alias("at"), F.date_format("f.at", "yyyy-MM").alias("period"))


def counted(refs: DataFrame) -> DataFrame:
    """(key, period, n, lo, hi): the references of each key and period, and their first and last moment."""
    return refs.where("key is not null").groupBy("key", "period").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))


def heavy_keys(groups: DataFrame, least: int = HEAVY_LEAST, most: int = HEAVY_KEYS) -> list[str]:
    """Keys holding at least max(least, total/most) references of ``counted``: at most ``most`` of them, so the list is bounded."""
    counts = groups.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = counts.orderBy(F.desc("n"), "key").limit(most).collect()
    limit = (groups.agg(F.sum("n")).first()[0] / most) if len(top) == most else 0
    return [r["key"] for r in top if r["n"] >= limit]


def _split(rows: DataFrame, present: DataFrame, heavy: list[str], meets: Column, kind: str, first: str, last: str, bound: int) -> DataFrame:
    """``rows`` joined with the intervals of their keys where ``meets``: heavy keys apart from the rest."""
    right = present.withColumnRenamed("key", "k")
    if not heavy:
        return rows.join(right, (F.col("key") == F.col("k")) & meets, kind)
    is_heavy = F.col("key").isin(heavy)
    rest = rows.where(~is_heavy).join(right.where(~F.col("k").isin(heavy)), (F.col("key") == F.col("k")) & meets, kind)
    mine = right.where(F.col("k").isin(heavy))
    if mine.limit(bound + 1).count() <= bound:
        hot = rows.where(is_heavy).join(F.broadcast(mine), (F.col("key") == F.col("k")) & meets, kind)
    else:
        span = rows.agg(F.min(first).alias("lo"), F.max(last).alias("hi")).first()
        lo, hi = F.lit(span["lo"]), F.lit(span["hi"])
        months = F.sequence(F.trunc(F.greatest("since", lo), "month"), F.trunc(F.least("until", hi), "month"), F.expr("interval 1 month"))
        spread = mine.where((F.col("since") <= hi) & (F.col("until") > lo)).withColumn("month", F.explode(months))
        spread = spread.select("k", "since", "until", F.date_format("month", "yyyy-MM").alias("p"))
        hot = rows.where(is_heavy).join(spread, (F.col("key") == F.col("k")) & (F.col("period") == F.col("p")) & meets, kind)
        hot = hot.drop("p")
    return rest.unionByName(hot)


def judged(groups: DataFrame, present: DataFrame, heavy: list[str], bound: int = BROADCAST_ROWS) -> DataFrame:
    """(key, period, n, lo, hi, verdict) of ``counted``: ``absent`` all orphans, ``there`` none, ``mixed`` to be looked at one by one."""
    touches = (F.col("since") <= F.col("hi")) & (F.col("until") > F.col("lo"))
    met = _split(groups, present, heavy, touches, "left", "lo", "hi", bound)
    covers = (F.col("since") <= F.col("lo")) & (F.col("until") > F.col("hi"))
    each = met.groupBy("key", "period").agg(F.max("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.count("since").alias("touched"), F.max(covers).alias("covered"))
    verdict = F.when(F.col("touched") == 0, "absent").when(F.col("covered"), "there").otherwise("mixed")
    return each.select("key", "period", "n", "lo", "hi", verdict.alias("verdict"))


def orphans(refs: DataFrame, present: DataFrame, groups: DataFrame, heavy: list[str], bound: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): the rows of ``references`` whose key does not exist at their time; and (key, period, at, n) of them.

    ``groups`` is what ``judged`` gave, stored. Of a group that is all orphans ``at`` is the first moment: no presence
    begins or ends within the group, so it stands for all.
    """
    inside = (F.col("at") >= F.col("since")) & (F.col("at") < F.col("until"))
    told = groups.where("verdict != 'there'").select("key", "period", "verdict")
    open_ = refs.where("key is not null").join(told, ["key", "period"])
    mixed = _split(open_.where("verdict = 'mixed'").drop("verdict"), present, heavy, inside, "left_anti", "at", "at", bound)
    rows = open_.where("verdict = 'absent'").select("ident", "key", "at", "period").unionByName(mixed.select("ident", "key", "at", "period"))
    counts = groups.where("verdict = 'absent'").select("key", "period", F.col("lo").alias("at"), "n")
    return rows, counts.unionByName(mixed.groupBy("key", "period", "at").agg(F.count(F.lit(1)).alias("n")))


def orphan_report(refs: DataFrame, present: DataFrame, lost: DataFrame, name: str) -> DataFrame:
    """Per table and period: records, references, orphans, and of these how many keys never come, come later or were removed.

    ``lost`` is the counts that ``orphans`` gave.
    """
    counts = refs.groupBy("period", "key").agg(F.count(F.lit(1)).alias("n"))
    base = counts.groupBy("period").agg(F.sum("n").alias("n_records"), F.sum(F.when(F.col("key").isNotNull(), F.col("n")).otherwise(0)).alias("n_references"))
    first = present.groupBy("key").agg(F.min("since").alias("first"))
    lost = lost.join(first, "key", "left")
    never, later = F.col("first").isNull(), F.col("at") < F.col("first")
    bad = lost.groupBy("period").agg(
        F.sum("n").alias("n_orphans"),
        F.sum(F.when(never, F.col("n")).otherwise(0)).alias("n_never"),
        F.sum(F.when(~never & later, F.col("n")).otherwise(0)).alias("n_later"),
        F.sum(F.when(~never & ~later, F.col("n")).otherwise(0)).alias("n_removed"),
    )
    out = base.join(bad, "period", "left")
    whole = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_records", "n_references", "n_orphans", "n_never", "n_later", "n_removed")]
    return out.select(F.lit(name).alias("table_name"), "period", *whole)
