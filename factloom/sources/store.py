"""Statement tables on disk: immutable versions, live and past statements apart, clustered by predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M


def save(statements: DataFrame, path: str, version: int, fmt: str = "parquet") -> None:
    """A version as a directory, partitioned by liveness so that Now reads no retracted row."""
    x = statements.select(*M.COLUMNS).withColumn("live", F.col("t_ret").isNull())
    x.repartitionByRange("live", "p", "s").sortWithinPartitions("p", "s").write.mode("errorifexists").partitionBy("live").format(fmt).save(f"{path.rstrip('/')}/version={version}")


def load(spark: SparkSession, path: str, version: int, view: M.View = M.HISTORY, fmt: str = "parquet") -> DataFrame:
    """A version's statements; under Now only the live partition is read."""
    x = spark.read.schema(f"{M.STATEMENT}, live string").format(fmt).load(f"{path.rstrip('/')}/version={version}")
    x = x.where("live = 'true'") if view.mode == "now" else x
    return x.select(*[F.col(c).cast(t) for c, t in (f.split() for f in M.STATEMENT.split(", "))])


def convert(spark: SparkSession, source: str, version: int, target: str, source_format: str, target_format: str) -> None:
    """The same statements under the same eids in another file format."""
    save(load(spark, source, version, fmt=source_format), target, version, target_format)
