"""Pages of the packet buffer and of the log table, and what is new since the last look.

A page begins behind a place, not at a number of rows, so rows that arrive meanwhile shift nothing.
Packets are in order of (ts, packet_id), log rows of id.  A page of packets reads the dates it
needs, found one after another from the cursor's date on by counting; a page costs the same
however many other dates the buffer has.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PACKETS_STORED
from .logtable import read_logs
from .packets import read_buffer


@dataclass(frozen=True)
class Cursor:
    """The place of the last row of a page."""

    ts: datetime.datetime
    packet_id: int


def buffer_dates(spark: SparkSession, path: str) -> list[datetime.date]:
    """Dates of the buffer, by the names of its folders."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [entry.getPath().getName() for entry in system.listStatus(folder)]
    return sorted(datetime.date.fromisoformat(n.removeprefix("dt=")) for n in names if n.startswith("dt=") and n[3:4].isdigit())


def _behind(df: DataFrame, after: Cursor | None) -> DataFrame:
    if after is None:
        return df
    ts = F.lit(after.ts).cast("timestamp_ntz")
    return df.where((F.col("ts") >= ts) & ((F.col("ts") > ts) | (F.col("packet_id") > after.packet_id)))


def _of_dates(spark: SparkSession, path: str, dates: list[datetime.date]) -> DataFrame:
    folders = [f"{path}/dt={d.isoformat()}" for d in dates]
    reader = spark.read.schema(PACKETS_STORED).option("basePath", path)
    return reader.parquet(*folders) if folders else spark.createDataFrame([], PACKETS_STORED)


def packet_page(spark: SparkSession, path: str, after: Cursor | None = None, limit: int = 100) -> DataFrame:
    """The next ``limit`` packets behind ``after``, in order; fewer only at the end."""
    chosen, rows = [], 0
    for date in buffer_dates(spark, path):
        if after is not None and date < after.ts.date():
            continue
        own = _behind(_of_dates(spark, path, [date]), after).count()  # of time and id only
        chosen += [date] if own else []
        rows += own
        if rows >= limit:
            break
    return _behind(_of_dates(spark, path, chosen), after).orderBy("ts", "packet_id").limit(limit)


def end_of(page: DataFrame) -> Cursor | None:
    """Where the next page begins; None behind an empty page."""
    last = page.agg(F.max(F.struct("ts", "packet_id")).alias("last")).first()["last"]
    return None if last is None else Cursor(last["ts"], last["packet_id"])


def log_page(spark: SparkSession, path: str, after: int = 0, limit: int = 100) -> DataFrame:
    """The next ``limit`` log rows with an id above ``after``, in order of id.

    The bound on the id reaches the scan, where row groups with smaller ids are skipped.
    """
    return read_logs(spark, path).where(F.col("id") > after).orderBy("id").limit(limit)


def packets_since(spark: SparkSession, path: str, source: str, batch: int = -1) -> DataFrame:
    """Packets that the streaming query ``source`` has written after its batch number ``batch``.

    Batch names are partition values: only files of newer batches are read.
    """
    named = F.regexp_extract("batch", r"^(.*)-(\d+)$", 1)
    number = F.regexp_extract("batch", r"^(.*)-(\d+)$", 2).cast("long")
    return read_buffer(spark, path).where((named == source) & F.when(named == source, number > batch).otherwise(False))
