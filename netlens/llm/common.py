"""What the operators share: tables, Arrow batches per task, held-out rows, checkpoints."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from netlens.session import ensure_checkpoint_dir

#: Rows in one Arrow batch. A document may be megabytes long, so batches are kept short.
BATCH_ROWS = 150


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for the queries of this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release() -> None:
    """Give memory that a task no longer uses back to the system; the Python worker lives on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, ddl: str, start: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """Apply a function to Arrow batches.

    ``start`` runs once in each task and returns the function; that maps the columns of one
    batch (name to Python list) to the columns of ``ddl``. Nothing outlives a batch but what
    ``start`` keeps.
    """
    kind = T.StructType.fromDDL(ddl)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(step(batch.to_pydict()), schema=target)
        del step
        release()

    return df.mapInArrow(run, kind)


def fold_batches(df: DataFrame, ddl: str, start: Callable[[], tuple[Callable[[dict], None], Callable[[], dict]]]) -> DataFrame:
    """Sum up each task: ``start`` returns a function that takes one batch's columns and one that
    gives the columns of ``ddl`` when all batches of the task are taken."""
    kind = T.StructType.fromDDL(ddl)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, end = start()
        for batch in batches:
            take(batch.to_pydict())
        yield pa.RecordBatch.from_pydict(end(), schema=target)
        del take, end
        release()

    return df.mapInArrow(run, kind)


def bounded_sample(df: DataFrame, column: str, bound: int, key: str = "doc_id", parts: int = 64) -> DataFrame:
    """At most ``bound`` rows of each value: those with the smallest hash of the key, the same each time.

    One pass for all values. Ranked in ``parts`` of each value first, so that a value with a third
    of all rows is no single task; what a value's last task sees is ``parts`` times ``bound`` rows.
    """
    part, rank = free_names(df, "_part", "_rank")
    rows = df.withColumn(part, F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.lit(parts)))
    for by in ([column, part], [column]):
        over = Window.partitionBy(*by).orderBy(F.xxhash64(key), key)
        rows = rows.withColumn(rank, F.row_number().over(over)).where(F.col(rank) <= bound)
    return rows.drop(part, rank)


def one_label(labels: DataFrame) -> DataFrame:
    """doc_id, label of the rows with an id and a label 0 or 1; of an id with both, the smaller."""
    known = labels.where("doc_id is not null and label in (0, 1)")
    return known.groupBy("doc_id").agg(F.min("label").alias("label"))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of the columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def id_remainder(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo: the fold of a document. Null for a null id."""
    return F.crc32(F.col(name).cast("string")) % modulus


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of fixed size with the bits at ``place`` set (the first bit of a byte is its highest).

    Tasks put it together in pieces of 64 kB at most, so what the driver gets is its size and no
    more, however many rows there are.
    """
    piece_bits = min(bits, 1 << 19)

    def put(rows: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(piece_bits, dtype=np.uint8)
        flags[rows["place"].to_numpy() % piece_bits] = 1
        return pd.DataFrame({"piece": [rows["piece"].iloc[0]], "bits": [np.packbits(flags).tobytes()]})

    dealt = places.select("place").distinct().withColumn("piece", F.col("place").bitwiseAND(~(piece_bits - 1)))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in dealt.groupBy("piece").applyInPandas(put, "piece int, bits binary").toLocalIterator():
        out[r["piece"] // 8 : (r["piece"] + piece_bits) // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def split_rows(df: DataFrame, place: Column, wanted: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose ``place`` is one of ``wanted`` (a few others with them), and rows
    whose is certainly not. The first part is joined exactly afterwards, the second is not shuffled."""
    sent = df.sparkSession.sparkContext.broadcast(bitmap(wanted, bits))

    @F.pandas_udf("boolean")
    def hit(places: pd.Series) -> pd.Series:
        p = places.to_numpy()
        return pd.Series((sent.value[p >> 3] >> (7 - (p & 7)) & 1).astype(bool))

    return df.where(hit(place)), df.where(~hit(place))


def stable(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame, rows_per_task: int = 100_000) -> tuple[DataFrame, int]:
    """``df`` checkpointed, and the tasks that its rows are worth, which later steps on it take.

    A table of a few rows otherwise keeps the partitions of the exchange it came from, and every
    further exchange writes files for each of them.
    """
    kept = stable(df)
    tasks = max(1, kept.count() // rows_per_task)
    return kept.coalesce(tasks), tasks
