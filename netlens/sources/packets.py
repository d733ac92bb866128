"""Raw packet scans and the packet buffer.

The buffer is a parquet folder of *decoded* packets, laid out as
``dt=<capture date>/iface=<interface>/batch=<name>``: a query of some dates lists those dates
only, later queries read header columns, and address filters are pushed to the scan.  ``raw`` is
stored last and is read only by queries that show bytes.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decode import destination_ip, fields, pack_layers, source_ip
from ..operators.filters import select_interface, truncate_snaplen
from ..schema import LAYERS, PACKETS_RAW, PACKETS_STORED
from ..session import stored
from . import files

MERGED = "merged"


def read_packets(
    spark: SparkSession,
    path: str,
    iface: str | None = None,
    interfaces: DataFrame | None = None,
    snaplen: int | None = None,
) -> DataFrame:
    """Raw frames from parquet, of one interface if named, cut to ``snaplen`` if asked for.

    An unknown interface is an error.
    """
    df = spark.read.schema(PACKETS_RAW).parquet(path)
    if iface is not None:
        df = select_interface(df, iface, interfaces)
    return truncate_snaplen(df, snaplen)


def stored_packets(df: DataFrame) -> DataFrame:
    """The stored form of raw packets (without the ``batch`` column)."""
    flat = fields(df).withColumns(
        {"src_ip": source_ip(), "dst_ip": destination_ip(), "dt": F.to_date("ts")}
    )
    return pack_layers(flat).select(
        "packet_id", "ts", "len", "src_ip", "dst_ip", *LAYERS, "raw", "dt", "iface"
    )


def append_packets(
    df: DataFrame, path: str, batch: str | None = None, rebalance: bool = False
) -> str:
    """Append packets, raw or in stored form, to the buffer; returns the batch name.

    A named batch that is repeated replaces the partitions it writes, so a retried micro-batch
    leaves no duplicates.  ``rebalance`` evens out file sizes with one shuffle that splits large
    dates and interfaces; without it every task writes its own files and nothing is shuffled.
    """
    name = batch or uuid.uuid4().hex
    if name == MERGED:
        raise ValueError(f"the batch name {MERGED!r} is taken")
    rows = (df if "dt" in df.columns else stored_packets(df)).withColumn("batch", F.lit(name))
    if rebalance:
        rows = rows.hint("rebalance", "dt", "iface")
    _write(rows, path)
    return name


def _write(rows: DataFrame, path: str) -> None:
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("dt", "iface", "batch").parquet(path)


def read_buffer(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """Every packet of the buffer; ``ordered`` sorts by arrival (a full sort)."""
    df = spark.read.schema(PACKETS_STORED).parquet(path)
    return df.orderBy("ts", "packet_id") if ordered else df


def merge_date(spark: SparkSession, path: str, date: datetime.date) -> None:
    """Put the batches of one past date together into few files.

    The merged rows are written beside the buffer first; then Spark's overwrite replaces the
    date's folder.  Nothing may write to that date meanwhile.
    """
    folder = f"{path}/dt={date.isoformat()}"
    if not files.exists(spark, folder):
        return
    rows = spark.read.schema(PACKETS_STORED).option("basePath", path).parquet(folder)
    rows = stored(rows.withColumn("batch", F.lit(MERGED)).hint("rebalance", "dt", "iface"), "merge")
    rows.drop("dt").write.mode("overwrite").partitionBy("iface", "batch").parquet(folder)


def clear_buffer(spark: SparkSession, path: str) -> None:
    """Empty the buffer; reading it gives no rows afterwards."""
    parts = ("dt", "iface", "batch")
    spark.createDataFrame([], PACKETS_STORED).drop(*parts).write.mode("overwrite").parquet(path)
