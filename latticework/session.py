"""Session and scratch-space helpers."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("latticework")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = _LOCAL.setdefault("root", "file://" + tempfile.mkdtemp(prefix="latticework-"))
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone; the folder is scratch space
        pass


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back.

    The copy survives the loss of any executor and is removed when the process ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the session's Python workers this package, once per application, by way of the shared folder."""
    app = spark.sparkContext.applicationId
    if _LOCAL.get("shipped") == app:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join(os.path.basename(here), os.path.relpath(full, here)))
    path = f"{scratch_root(spark)}/{os.path.basename(here)}-{uuid.uuid4().hex}.zip"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(held.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)
    _LOCAL["shipped"] = app


def spread(df: DataFrame) -> DataFrame:
    """For work that is not in the bytes: a scan of fewer splits than there are cores is dealt out to all; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, where: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{where}/{name}.parquet")
