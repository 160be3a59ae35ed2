"""Operators on tables of structure records: flags, filters with reasons, ids, duplicates, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import scalar as S
from latticework.functions.ids import id_key

MODIFICATIONS = ("perturb", "deformation", "vacancy", "replacement")
TYPES = ("bulk", "surface", "cluster", "isolated_atom")


def flagged(structures: DataFrame) -> DataFrame:
    """Structure records with plain labels and one boolean per type and modification; ``base`` records have no modification."""
    mods = S.modifications("modifications")
    rows = structures.select(
        id_key("atl_id").alias("key"), "atl_id", "formula", "n_atoms", S.label("phase").alias("phase"), S.label("struct_type").alias("struct_type"),
        mods.alias("mods"), (F.col("calc_performed") == 1).alias("labelled"), S.number_or_null("calc_energy").alias("energy"), "recorded_at", "removed_at",
    )
    flags = [F.array_contains("mods", m).alias(m) for m in MODIFICATIONS] + [F.coalesce(F.col("struct_type") == t, F.lit(False)).alias(t) for t in TYPES]
    return rows.select("*", *flags, (F.size("mods") == 0).alias("base"))


def keep_any(df: DataFrame, flags: list[str], phase: str | None = None, dedupe: bool = False) -> DataFrame:
    """Rows with any of the flags. By default a row comes once per true flag (a bag); ``dedupe`` gives it once."""
    df = df.where(F.col("phase") == phase) if phase is not None else df
    if dedupe:
        return df.where(reduce(lambda a, b: a | b, [F.col(f) for f in flags]))
    hits = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in flags]))
    return df.withColumn("hit", F.explode(hits)).drop("hit")


def keep_none(df: DataFrame, flags: list[str]) -> DataFrame:
    """The rows that none of the flags selects; null flags select nothing."""
    return df.where(~reduce(lambda a, b: a | b, [F.coalesce(F.col(f), F.lit(False)) for f in flags]))


def with_reasons(df: DataFrame, filters: dict[str, Column], exempt: Column | None = None) -> DataFrame:
    """All reasons and the first one for which a row is to go. A filter that gives null does not hit."""
    hit = lambda n, c: F.when(F.coalesce(c, F.lit(False)) & ~(exempt if exempt is not None else F.lit(False)), F.lit(n))
    marks = [hit(n, c) for n, c in filters.items()]
    return df.withColumn("removal_reason", S.reasons(*marks)).withColumn("first_reason", F.coalesce(*marks) if marks else F.lit(None).cast("string"))


def unconverged(scf: Column, ionic: Column, relaxation: Column, *, need_scf: bool = True, need_ionic: bool = False, drop_unknown: bool = False) -> Column:
    """Whether a calculation is to go for want of convergence; null flags are unknown, and unknown goes only on request."""
    bad = F.lit(False)
    for flag, need in ((scf, need_scf), (ionic, need_ionic)):
        if need:
            applies = relaxation if flag is ionic else F.lit(True)
            bad = bad | (F.coalesce(applies, F.lit(False)) & F.coalesce(~flag, F.lit(drop_unknown)))
    return bad


def tri_state(df: DataFrame, flags: list[str]) -> DataFrame:
    """One row per flag: how many are true, false and unknown. One pass."""
    count = [F.struct(F.lit(f).alias("flag"), F.count_if(F.col(f)).alias("n_true"), F.count_if(~F.col(f)).alias("n_false"), F.count_if(F.col(f).isNull()).alias("n_unknown")) for f in flags]
    return df.agg(F.array(*count).alias("a")).select(F.inline("a"))


def id_problems(df: DataFrame, key: str = "key") -> DataFrame:
    """(key, n): missing ids as one null group, and ids that several rows share."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))


def repair_ids(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """``repeat``: 0 for the first row of an id, then 1, 2...; ``needs_id``: whether a row must get an id (missing, or not the first)."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn("repeat", first).withColumn("needs_id", F.col(key).isNull() | (F.col("repeat") > 0))


def keep_first(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group; the row_number limit is applied before the shuffle as well."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = ()) -> DataFrame:
    """New rows replace old ones of the same key, but columns in ``keep`` stay as they were if they were there."""
    o, n = old.alias("o"), new.alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key])
    there = F.col("n._there").isNotNull()
    joined = o.join(n.withColumn("_there", F.lit(1)).alias("n"), on, "full_outer")
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keep or c in key else F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*[pick(c).alias(c) for c in old.columns])


def database_type(df: DataFrame) -> Column:
    """One type per record, by priority: isolated atom, base, bulk, surface, cluster."""
    return F.when(F.col("isolated_atom"), "isolated_atom").when(F.col("base"), "base").when(F.col("bulk"), "bulk").when(F.col("surface"), "surface").when(F.col("cluster"), "cluster").otherwise("unknown")


def cleanup(df: DataFrame, filters: dict[str, Column], duplicate_of: list[str], *order: Column | str) -> DataFrame:
    """Every record with its fate: kept, or removed by a filter, or removed as a repeat of an earlier kept one. Filters go first."""
    marked = with_reasons(df, filters, F.col("isolated_atom"))
    fine = F.col("first_reason").isNull()
    nth = F.row_number().over(Window.partitionBy(fine, *duplicate_of).orderBy(*order))
    return marked.withColumn("nth", nth).withColumn("fate", F.when(~fine, "filter").when(F.col("nth") > 1, "duplicate").otherwise("kept")).drop("nth")
