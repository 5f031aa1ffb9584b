"""Cutting lineage in driver loops: frames computed once into the folder the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PARTITIONS, COALESCE = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
PART_BYTES = 8 << 20  #: of files read that a task of a shuffle holds, where that makes more tasks than there are cores


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did; a cluster without that path gets it by --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where that is unset, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="factloom-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def parts(df: DataFrame) -> int:
    """How many tasks the files that df reads make at PART_BYTES each; 0 where the cores are enough."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(x.stats().sizeInBytes())) for x in map(leaves.apply, range(leaves.size())) if x.getClass().getSimpleName() == "LogicalRelation")
    n = -(-size // PART_BYTES)
    return n if n > df.sparkSession.sparkContext.defaultParallelism else 0


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to tasks whose number grows with its input, so that what follows by these keys holds a bounded share of rows."""
    n = parts(df) if keys else 0
    return df.repartition(n, *keys) if n else df


@contextmanager
def having(spark: SparkSession, conf: dict):
    """The session with other settings."""
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def computing(df: DataFrame, least: int = 0):
    """A plan of df's own, to be run in the block: in as many tasks as its input needs, or least, whose shuffles are dropped as it ends."""
    spark = df.sparkSession
    with having(spark, {CLEANUP: "true"}):
        x = df.select("*")
        n = max(parts(x), least)
        with having(spark, {PARTITIONS: max(n, int(spark.conf.get(PARTITIONS))), COALESCE: "false"} if n else {}):
            yield x


def settled(df: DataFrame, least: int = 0) -> DataFrame:
    """df checkpointed to the shared folder; the shuffles behind it are dropped at once. least: tasks, where df rests on settled frames."""
    shared_dir(df.sparkSession)
    with computing(df, least) as x:
        return x.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as compressed Parquet in the shared folder, of which later reads take only the columns they need.

    The files are deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{what}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    with computing(df) as x:
        x.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Layers:
    """Rows that grow by a settled layer at a time.

    A layer is written once, and again only when MOST of them are merged, which keeps the plan
    of their union short however many rounds a loop takes.
    """

    MOST = 12

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, layer: DataFrame) -> None:
        self.parts.append(layer)
        if len(self.parts) > self.MOST:  # the first part holds what was merged before
            self.parts = [settled(self.rows)]

    @property
    def rows(self) -> DataFrame:
        out = self.parts[0]
        for x in self.parts[1:]:
            out = out.unionByName(x)
        return out


def numbered(df: DataFrame, order: list, name: str, start: int = 1) -> DataFrame:
    """df settled in an order, with its rows' places in it (start, start + 1, ...) as a column.

    Rows are sorted by ranges over all tasks; only the ranges' sizes, a row each, meet in one.
    """
    x = df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    x = settled(x)
    sizes = x.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    offsets = sizes.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    at = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return x.join(F.broadcast(offsets), F.col("__part") == F.col("__p")).select(*df.columns, (F.col("__before") + at + start).cast("bigint").alias(name))
