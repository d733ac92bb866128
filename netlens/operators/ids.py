"""Ids for new rows, without a single-partition window over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

_ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id: row number in the low 33 bits


def _starts(counts: DataFrame, order: list[Column]) -> DataFrame:
    """Rows before each part; ``counts`` has one row per task, which bounds this one window."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def assign_ids(df: DataFrame, last_id: int, order_by: list[str] | None = None, id_col: str = "id") -> DataFrame:
    """Add dense ids ``last_id + 1, last_id + 2, ...``.

    The rows are written once, sorted if an order is asked for (which should identify a row, so
    that no range is one value).  A row's id follows from its file and its place there, both
    known to the reader; counting reads no column.
    """
    rows = stored(df.orderBy(*order_by) if order_by else df, "ids")
    name = F.col("_metadata.file_name")
    counts = rows.groupBy(name.alias("_of")).agg(F.count("*").alias("_n"))
    task = F.regexp_extract("_of", r"part-(\d+)", 1).cast("long")
    starts = _starts(counts, [task, F.col("_of")]).select("_of", "_start")
    placed = rows.select("*", name.alias("_file"), F.col("_metadata.row_index").alias("_pos"))
    # One row per written file: bounded by the number of tasks.
    return (
        placed.join(F.broadcast(starts), F.col("_file") == F.col("_of"))
        .withColumn(id_col, F.lit(last_id) + F.col("_start") + F.col("_pos") + 1)
        .drop("_file", "_pos", "_start", "_of")
    )


def number_in_place(df: DataFrame, first: int, id_col: str = "id", counts: DataFrame | None = None) -> DataFrame:
    """Add ids ``first, first + 1, ...`` in the order of the partitions; no row is moved or written.

    Counts and rows are computed apart, so ``df`` must give the same partitions each time: stored
    or cached rows, filtered and projected only.  ``counts`` takes ``partition_counts`` known before.
    """
    ranked = df.withColumns(
        {"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id().bitwiseAND(_ROW_BITS)}
    )
    counts = partition_counts(df) if counts is None else counts
    starts = _starts(counts, [F.col("_part")]).select(F.col("_part").alias("_of"), "_start")
    return (
        ranked.join(F.broadcast(starts), F.col("_part") == F.col("_of"))
        .withColumn(id_col, F.lit(first) + F.col("_start") + F.col("_pos"))
        .drop("_part", "_pos", "_start", "_of")
    )


def partition_counts(df: DataFrame) -> DataFrame:
    """``_part, _n``: rows of each partition, a row for each task."""
    return df.groupBy(F.spark_partition_id().alias("_part")).agg(F.count("*").alias("_n"))
