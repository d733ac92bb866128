"""What the library needs from the session: settings and a shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Settings that can be changed while a session runs.  The JVM does not compile
# methods beyond 8000 bytes; with this limit Spark splits a long projection into
# several methods instead (the full decode ran two to three times faster).
# Spark's parquet reader holds a batch of rows in one array, doubled as it fills:
# 4096 frames, its default, of 64 kB are more than an executor has for a task.
RUNTIME_SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.parquet.columnarReaderBatchSize": "256",
}

#: Folders given out by ``scratch_dir`` and not removed yet.
_SCRATCH: list[str] = []


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def _in_one_process(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a temporary
    folder, since driver and executors are one process there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not _in_one_process(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="netlens-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable."""
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new path under the shared folder, removed by ``remove_scratch`` or when Python ends."""
    if not _SCRATCH:
        atexit.register(_at_exit)
    _SCRATCH.append(f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def remove_scratch(spark: SparkSession) -> None:
    """Remove what this application wrote to scratch folders; DataFrames that read them end."""
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        remove_scratch(spark)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage, computes the rows once, and gives them a true size, so
    that what is small is also known to be small.
    """
    folder = scratch_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
