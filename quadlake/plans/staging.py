"""Cutting the lineage of iterative plans with tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named, local mode gets one of our own; a
    cluster has to name one, as a folder of one machine is not seen by the others."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quadlake-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of our own in the shared folder; what is there at exit is deleted."""
    path = f"{folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_forget, spark, path)
    return path


def cut(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df, computed once and read back. Like a reliable checkpoint it outlives executors; unlike one it doesn't compute twice."""
    spark = df.sparkSession
    path = new_path(spark, "cut")
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that ``cut`` gave and that nothing will read again."""
    _forget(df.sparkSession, df._cut_at)


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
