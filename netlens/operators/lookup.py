"""Equi joins against lookup tables.

``lookup_join`` is the one join used for ARP mappings, enrichment and host sets.  It is a plain
left join that reads the left side once and carries no hint: Spark's own threshold decides on a
broadcast, adaptive execution converts a join whose side turned out small and splits partitions
of a hot key by their size.  A hint would forbid that, and no estimate made before the query runs
bounds a compressed table.

Rows without a key match nothing and would all meet in one partition.  They carry a second join
key, a hash of ``spread_by``, and so go evenly to all partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(
    left: DataFrame, lookup: DataFrame, left_key: str, lookup_key: str, spread_by: str, strategy: str | None = None
) -> DataFrame:
    """Left join of ``left`` with a lookup that has one row per key.

    ``spread_by`` names a high-cardinality column of ``left`` (such as the packet id).
    The lookup's key column is dropped.  ``strategy`` is a join hint of Spark's, for a caller
    who knows better; none is given otherwise.
    """
    spread = F.when(F.col(left_key).isNull(), F.xxhash64(spread_by)).otherwise(F.lit(0).cast("long"))
    right = lookup.withColumnRenamed(lookup_key, "_key").withColumn("_same", F.lit(0).cast("long"))
    right = right.hint(strategy) if strategy else right
    joined = left.withColumn("_spread", spread).join(
        right, (F.col(left_key) == F.col("_key")) & (F.col("_spread") == F.col("_same")), "left"
    )
    return joined.drop("_key", "_spread", "_same")


def exists_flag(left: DataFrame, keys: DataFrame, left_key: str, keys_key: str, flag: str, spread_by: str, **options) -> DataFrame:
    """Add boolean ``flag``: does the row's key occur in ``keys``?  Never null."""
    marked = (
        keys.select(F.col(keys_key).alias("_member"))
        .filter(F.col("_member").isNotNull())
        .distinct()
        .withColumn(flag, F.lit(True))
    )
    joined = lookup_join(left, marked, left_key, "_member", spread_by, **options)
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))
