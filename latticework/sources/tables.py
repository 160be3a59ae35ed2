"""Reading and writing by suffix, atomic replacement, load-or-compute, records as text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffix -> format.
FORMATS = {"parquet": "parquet", "json": "json", "jsonl": "json", "csv": "csv", "orc": "orc", "xyz": "extxyz", "extxyz": "extxyz"}


def format_of(path: str) -> str:
    tail = path.rstrip("/").rpartition(".")[2].lower()
    return FORMATS.get(tail, "parquet")


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    kind = format_of(path)
    if kind == "extxyz":
        from latticework.sources.extxyz import register

        register(spark)
    r = spark.read.format(kind)
    r = r.option("header", True) if kind == "csv" else r
    return (r.schema(schema) if schema and kind != "extxyz" else r).load(path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def write(df: DataFrame, path: str, keep_existing: bool = False) -> None:
    """Write beside the target, then swap: a failed write leaves the old table. With ``keep_existing`` a table that is there is left alone."""
    spark = df.sparkSession
    target, fs = _fs(spark, path)
    if keep_existing and fs.exists(target):
        return
    kind = format_of(path)
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}"
    if kind == "extxyz":
        from latticework.sources.extxyz import register

        register(spark)
    try:
        w = df.write.format(kind)
        w = w.option("header", True) if kind == "csv" else w
        w.mode("overwrite" if kind != "extxyz" else "append").save(beside)
    except Exception:
        fs.delete(_fs(spark, beside)[0], True)
        raise
    old = _fs(spark, f"{beside}.old")[0]
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(_fs(spark, beside)[0], target)
    fs.delete(old, True)


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """The table at a path, computed and written first if it is not there."""
    if overwrite or not exists(spark, path):
        write(compute(), path)
    return read(spark, path)


def to_text(df: DataFrame, column: str = "record") -> DataFrame:
    """Each row as JSON."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))


def from_text(df: DataFrame, schema: str, column: str = "record") -> DataFrame:
    """Rows out of JSON; text that is no such record gives a row of nulls."""
    return df.select(F.from_json(column, schema).alias("r")).select("r.*")


#: Atomic units.
BOHR, HARTREE = 0.529177210903, 27.211386245988
#: Boltzmann constant in eV per kelvin.
BOLTZMANN = 8.617333262e-05


def n2p2_record(comment: Column, atoms: Column, energy: Column) -> Column:
    """One training record in atomic units; ``atoms`` is an array of structs (symbol, x, y, z, fx, fy, fz)."""
    f = HARTREE / BOHR
    line = lambda a: F.format_string("atom %16.8f %16.8f %16.8f %s 0.0 0.0 %16.8f %16.8f %16.8f", a["x"] / BOHR, a["y"] / BOHR, a["z"] / BOHR, a["symbol"], a["fx"] / f, a["fy"] / f, a["fz"] / f)
    return F.concat_ws("\n", F.lit("begin"), F.concat(F.lit("comment "), comment), F.array_join(F.transform(atoms, line), "\n"), F.format_string("energy %.8f", energy / HARTREE), F.lit("charge 0.0"), F.lit("end"))
