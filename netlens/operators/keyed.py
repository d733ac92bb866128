"""Keyed append and key existence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import exists_flag


def key_exists(keys: DataFrame, target: DataFrame, key: str, target_key: str, spread_by: str, **options) -> DataFrame:
    """Add ``exists``: does any row of ``target`` have the key?"""
    return exists_flag(keys, target.select(target_key), key, target_key, "exists", spread_by, **options)


def append_status(target: DataFrame, batch: DataFrame, key: str, seq: str) -> DataFrame:
    """``batch`` with ``accepted``: may the row be appended to ``target``?

    Accepted are rows whose key is new, of a repeated key only the first by
    ``seq`` (unique in the batch), and all rows with a null key.
    """
    keyed = batch.filter(F.col(key).isNotNull())
    first = keyed.groupBy(F.col(key).alias("_key")).agg(F.min(seq).alias("_first"))
    taken = (
        target.select(F.col(key).alias("_key"))
        .filter(F.col("_key").isNotNull())
        .join(first.select("_key"), "_key", "left_semi")
    )
    fresh = first.join(taken, "_key", "left_anti").select("_first")
    marked = batch.join(
        fresh.withColumn("_new", F.lit(True)), F.col(seq) == F.col("_first"), "left"
    )
    accepted = F.col(key).isNull() | F.col("_new").isNotNull()
    return marked.withColumn("accepted", accepted).drop("_first", "_new")


def insert_if_absent(
    target: DataFrame, batch: DataFrame, key: str, seq: str
) -> tuple[DataFrame, DataFrame]:
    """``(target with the accepted rows, refused rows)``."""
    status = append_status(target, batch, key, seq)
    accepted = status.filter("accepted").select(target.columns)
    return target.unionByName(accepted), status.filter(~F.col("accepted")).drop("accepted")
