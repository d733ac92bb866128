"""The log table as plain parquet folders.

Every batch of log rows is a folder of its own, ``dt=<date>/writer=<n>/source=<id>/batch=<n>``,
written by Spark's overwrite of exactly these partitions.  A repeated batch replaces itself, two
sources never touch the same folder, and a reader needs no list of commits.  An id is made of
batch, writer and position, so it is unique, and rises within a source, without asking the table.

Updates and deletes are the DataFrame operations of ``operators.logs``; ``write_table`` stores
their result in a new folder, which ``read_logs`` reads as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ids import number_in_place
from ..operators.logs import LOG_COLUMNS, validate_logs, violations, with_defaults
from ..schema import LOGS

#: Layout of an id, from high to low: batch (28 bits), writer (4 bits), position in the batch.
POSITION_BITS, WRITER_BITS, BATCH_BITS = 31, 4, 28
#: Log rows of one batch.
MOST_ROWS = (1 << POSITION_BITS) - 1

_PARTS = [
    T.StructField("dt", T.DateType()),
    T.StructField("writer", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("batch", T.LongType()),
]
_STORED = T.StructType([*LOGS, *_PARTS])


def first_id(batch: int, writer: int) -> int:
    """The id before the first one of a batch."""
    if not (0 <= batch < 1 << BATCH_BITS and 0 <= writer < 1 << WRITER_BITS):
        raise ValueError(f"no ids for batch {batch} of writer {writer}")
    return (batch << WRITER_BITS | writer) << POSITION_BITS


def write_logs(df: DataFrame, path: str, source: str, batch: int = 0, writer: int = 0, rejects: str | None = None) -> DataFrame:
    """Write one batch of new log rows under new ids; returns the rejected rows.

    ``df`` is evaluated more than once and must give the same partitions each time (stored or
    cached rows).  Sources that share a folder take different writer numbers.  Rows are counted
    first: a batch with more of them than ids have positions for is an error, and nothing is
    written.  Rejected rows are also written to ``rejects``, if that is given and there are any.
    """
    first = first_id(batch, writer) + 1
    valid, rejected = validate_logs(df)
    marked = df.select(F.spark_partition_id().alias("_part"), (F.size(violations(df.columns)) == 0).alias("_valid"))
    found = marked.groupBy("_part").agg(F.count_if("_valid").alias("_n"), F.count("*").alias("_all")).collect()  # one row for each task
    if sum(r["_n"] for r in found) > MOST_ROWS:
        raise ValueError(f"batch {batch} has more than {MOST_ROWS} rows; cut it into smaller ones")
    counts = df.sparkSession.createDataFrame([(r["_part"], r["_n"]) for r in found], "_part int, _n long")
    rows = with_defaults(number_in_place(valid.drop("id"), first, counts=counts)).select(LOG_COLUMNS)
    parts = {"dt": F.to_date("timestamp"), "writer": F.lit(writer), "source": F.lit(source), "batch": F.lit(batch)}
    (
        rows.withColumns(parts)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(path)
    )
    if rejects is not None and any(r["_n"] < r["_all"] for r in found):
        rejected.write.mode("overwrite").parquet(rejects)
    return rejected


def write_table(logs: DataFrame, path: str) -> None:
    """Store a whole log table in a new folder, ids as they are."""
    logs.select(LOG_COLUMNS).write.parquet(path)


def stored_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log rows with the date, writer, source and batch that they were written under."""
    return spark.read.schema(_STORED).parquet(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """All log rows at ``path``; no order is promised."""
    return spark.read.schema(LOGS).parquet(path)


def other_source(spark: SparkSession, path: str, source: str, writer: int) -> str | None:
    """Another source that has written to ``path`` under the same writer number."""
    rows = stored_logs(spark, path).filter((F.col("writer") == writer) & (F.col("source") != source))
    found = rows.select("source").first()
    return found["source"] if found else None


def clear_logs(spark: SparkSession, path: str) -> None:
    """Empty the log table."""
    spark.createDataFrame([], LOGS).write.mode("overwrite").parquet(path)
