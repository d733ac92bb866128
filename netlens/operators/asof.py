"""As-of join: for each row the last value known at its time, without a range join.

Time is cut into buckets of ``width`` seconds.  What is in force where a bucket begins is found from
one row for each key and bucket (the last value in it); inside a bucket rows and values are
sorted together.  So a key with a third of all rows is spread over its buckets, and no pair of a
row and a value is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_of(at: Column, width: int) -> Column:
    """Number of the time bucket of ``width`` seconds."""
    return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(width * 1_000_000)).cast("long")


def asof_join(rows: DataFrame, values: DataFrame, key: str, at: str, seq: str, taken: list[str], width: int = 3_600) -> DataFrame:
    """Add the columns ``taken`` of the last row of ``values`` with the same ``key`` that is not
    later than the row by (``at``, ``seq``); null where there is none.

    Both sides have ``key``, ``at`` and ``seq``.  A null key matches nothing.
    """
    value = F.struct(*taken)
    bucket = bucket_of(F.col(at), width)
    left = rows.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.col(seq).alias("_seq"), F.struct(*rows.columns).alias("_row"))
    right = values.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.col(seq).alias("_seq"), value.alias("_value"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_bucket", bucket_of(F.col("_at"), width))

    # One row for each key and bucket: combined before the shuffle.
    last = both.groupBy("_key", "_bucket").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct("_at", "_seq"))).alias("_value")
    )
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_key", "_bucket", F.last("_value", ignorenulls=True).over(before).alias("_value"))
    carried = carried.where(F.col("_value").isNotNull())

    # A carried value comes first in its bucket, a value before a row of the same place.
    every = both.unionByName(carried, allowMissingColumns=True)
    so_far = Window.partitionBy("_key", "_bucket").orderBy(F.col("_at").asc_nulls_first(), "_seq", F.col("_row").isNotNull())
    so_far = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = every.withColumn("_found", F.last("_value", ignorenulls=True).over(so_far)).where(F.col("_row").isNotNull())
    return found.select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in taken])
