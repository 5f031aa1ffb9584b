"""What the training-data operators share: reading, storing in the shared folder, freeing."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FREQUENT = 10_000  #: hot groups broadcast at most


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did, where they see that path.

    A cluster without it gets the package by --py-files, as any other.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and Spark is local (tests) a folder of our own is made; on a cluster
    it has to be set, as executors do not see a folder of the driver.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
    return sc.getCheckpointDir()


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """Jobs of the block delete their shuffle files as they end: their results are kept elsewhere."""
    old = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, old)


def settled(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder; its lineage ends there and its shuffles are dropped.

    Spark removes the files when the last frame that reads them is garbage, if
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    spark = df.sparkSession
    shared_dir(spark)
    collected(spark)
    with dropping_shuffles(spark):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under the setting


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as compressed Parquet to the shared folder and read back; for large tables.

    The files are deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/factloom-{what}-{uuid.uuid4().hex}"
    collected(spark)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    with dropping_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collected(spark: SparkSession) -> None:
    """Lets go of frames that nobody holds any more, which keeps the driver small."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def frequent(counts: DataFrame, rows: int, most: int = FREQUENT) -> DataFrame:
    """The rows of counts (with a column n that adds up to rows at most) that hold a hot group, to broadcast.

    A group counts as hot from 1 / most of all rows on, so there are never more than most.
    """
    return F.broadcast(counts.where(F.col("n") >= max(1000, -(-rows // most))))


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))
