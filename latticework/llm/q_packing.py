"""Problem 6: speeches packed into containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import packing, tokens
from latticework.session import materialise, table


def p6_assigned(spark: SparkSession, d: str) -> DataFrame:
    sizes = materialise(tokens.sizes(table(spark, d, "documents")), "sizes")
    return packing.pack(sizes, table(spark, d, "pack_capacities"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_report(p6_assigned(spark, d), table(spark, d, "pack_capacities"))


def p6_rules(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity the documents packed; overfull bins, lost tokens and documents divided though they fit: none."""
    sizes = materialise(tokens.sizes(table(spark, d, "documents")), "sizes")
    caps = table(spark, d, "pack_capacities")
    packed = materialise(packing.pack(sizes, caps), "packed")
    over = packed.groupBy("pack_id", "bin_id").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(caps.select("pack_id", "capacity")), "pack_id").groupBy("pack_id").agg(F.count_if(F.col("n") > F.col("capacity")).alias("overfull"))
    docs = packed.groupBy("pack_id", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces")).join(sizes, "doc_id").join(F.broadcast(caps.select("pack_id", "capacity")), "pack_id")
    docs = docs.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.abs(F.col("n") - F.col("n_tokens"))).alias("lost_tokens"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity"))).alias("wrongly_divided"))
    return docs.join(over, "pack_id").select("pack_id", "n_documents", "overfull", "lost_tokens", "wrongly_divided")


QUERIES = {"p6_assigned": p6_assigned, "p6_report": p6_report, "p6_rules": p6_rules}
ORACLES: dict[str, str] = {
    "p6_rules": "select pack_id, (select count(*) from documents where text <> '') as n_documents, 0::bigint as overfull, 0::bigint as lost_tokens, 0::bigint as wrongly_divided from pack_capacities where capacity > 0"
}
