"""What the corpus operators share: the shared folder, staged tables and worker code that travels by value.

Staged tables are Parquet in the folder that the cluster names in ``spark.checkpoint.dir``. They cut lineage like a
reliable checkpoint does, but are columnar, keep their row ids, and outlive any executor.
"""

from __future__ import annotations

import atexit
import functools
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII separators.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def travels(name: str) -> None:
    """Worker functions of this module are pickled by value, so executors need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named, local mode gets one of our own; a cluster has to name one, as a
    folder of one machine is not seen by the others."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quadlake-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_forget, spark, path)
    return path


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back."""
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_staged_at", None):
            drop_path(spark, path)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like these that none of the taken ones equals, whatever its case."""
    low, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in low:
            n += "_"
        low.add(n.lower())
        out.append(n)
    return out


def columns(names: list[str]) -> list:
    """Columns by name, dots and backquotes included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        drop_path(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size of a plan's input; for files their total length, read from metadata alone."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(df: DataFrame, target_bytes: int, least: int) -> int:
    """Partitions of about target_bytes each, at least ``least``; grows with the input."""
    size = plan_bytes(df)
    return max(least, -(-min(size, 1 << 60) // target_bytes)) if size < 1 << 60 else least


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text) -> F.Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"({WORD})")), F.lit(0)).cast("long")


def small(batches, rows: int = 512):
    """Slices of few rows of Arrow batches: texts have no longest length, and a worker holds what it makes of a slice, not
    of a batch. Spark bounds the batches themselves by bytes (spark.sql.execution.arrow.maxBytesPerBatch)."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def together(batches, rows: int = 2048, size: int = 8 << 20):
    """Small Arrow batches put together, until there are so many rows or bytes, for work that many texts share."""
    import pyarrow as pa

    held, n, held_bytes = [], 0, 0
    for b in batches:
        held.append(b)
        n, held_bytes = n + b.num_rows, held_bytes + b.nbytes
        if n >= rows or held_bytes >= size:
            yield pa.concat_batches(held)
            held, n, held_bytes = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def small_batches(f, rows: int = 512):
    """f(spark, ...) with Arrow batches of few rows, which spares what executors hold beside their heap; the session's own
    setting is put back. What f returns has to be staged, or free of Python: a plan runs by the setting of its time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"

    @functools.wraps(f)
    def run(spark, *a, **k):
        was = spark.conf.get(key)
        spark.conf.set(key, rows if int(was) <= 0 else min(int(was), rows))
        try:
            return f(spark, *a, **k)
        finally:
            spark.conf.set(key, was)

    return run


travels(__name__)
