"""Cleaning a structure database: ids, filters, repeats, report; as a plan over DataFrames and over stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import plugins
from latticework.operators import records
from latticework.session import materialise
from latticework.sources import tables


@dataclass
class Cleaned:
    kept: DataFrame
    removed: DataFrame
    report: DataFrame


def clean(structures: DataFrame, settings: dict, repeats_by: tuple[str, ...] = ("phase", "formula", "n_atoms", "energy"), order: tuple[str, ...] = ("recorded_at", "atl_id")) -> Cleaned:
    """Filters go before the search for repeats, isolated atoms are exempt from filters. The marked table is stored once and read by all three results."""
    flagged = structures if "base" in structures.columns else records.flagged(structures)
    marked = records.cleanup(flagged, plugins.filters(settings), list(repeats_by), *order)
    marked = materialise(records.repair_ids(marked, "key", *order), "cleanup")
    kept = marked.where("fate = 'kept'")
    removed = marked.where("fate != 'kept'").withColumn("removal_reason", F.when(F.col("fate") == "duplicate", "duplicate").otherwise(F.col("removal_reason")))
    report = marked.groupBy("fate", F.coalesce("first_reason", F.lit("")).alias("reason"), F.coalesce("phase", F.lit("unknown")).alias("phase"), F.coalesce("struct_type", F.lit("unknown")).alias("struct_type")).agg(F.count(F.lit(1)).alias("n"), F.count_if("needs_id").alias("n_ids_to_repair"))
    return Cleaned(kept, removed, report)


def clean_table(spark: SparkSession, path: str, settings: dict, output: str | None = None, removed: str | None = None, in_place: bool = False, dry_run: bool = False, report: str | None = None) -> DataFrame:
    """Clean a stored database. In place, the old table stays beside the new one as ``.bak``; a dry run writes nothing."""
    source = tables.read(spark, path)
    done = clean(source, settings)
    if not dry_run:
        if in_place:
            tables.write(source, f"{path.rstrip('/')}.bak")
            tables.write(done.kept, path)
        elif output:
            tables.write(done.kept, output)
        if removed:
            tables.write(done.removed, removed)
        if report:
            done.report.coalesce(1).write.mode("overwrite").json(report)
    return done.report
