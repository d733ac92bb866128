"""TCP byte streams put together from captured segments.

Sequence numbers count modulo 2^32 and a port is used again by later connections.  So the numbers
are first unrolled: the signed difference from one segment of a flow to the next, summed up in
order of capture; a SYN with a number of its own begins the next connection.  Both sums are taken
inside buckets of time and then carried over the buckets (one row each), so that a flow with a
third of all packets is many small windows.

A segment's place in its connection gives the chunks of ``CHUNK`` bytes it belongs to.  Each chunk is
filled by one pass over its segments in order of capture: of bytes that come twice the first
stay.  A task holds one chunk, however long a connection is and however often a segment is repeated;
where only the first bytes of connections are asked for, it holds those of one connection.

One direction of a connection is one stream.  Without a SYN in the capture (connection 0) it
begins at the least byte seen.  Bytes before the beginning are left out; a gap stays a gap.
"""

from __future__ import annotations

import datetime
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .asof import bucket_of
from .decode import tcp_segments

FLOW = ["src_ip", "src_port", "dst_ip", "dst_port"]
CHUNK = 65_536
#: Seconds of a bucket in which sequence numbers are unrolled first.
WIDTH = 600

STREAM = "src_ip string, src_port int, dst_ip string, dst_port int, connection long, offset long, data binary, seen timestamp_ntz"
ARROW = pa.schema(
    [("src_ip", pa.string()), ("src_port", pa.int32()), ("dst_ip", pa.string()), ("dst_port", pa.int32()),
     ("connection", pa.int64()), ("offset", pa.int64()), ("data", pa.binary()), ("seen", pa.timestamp("us"))]
)

HEAD = STREAM.replace("offset long, data binary", "head binary")
HEAD_ARROW = pa.schema([*list(ARROW)[:5], ("head", pa.binary()), ("seen", pa.timestamp("us"))])


def _signed(difference: Column) -> Column:
    """A difference of sequence numbers as the nearest signed step."""
    half = F.lit(1 << 31)
    return F.pmod(difference + half, F.lit(1 << 32)) - half


def _in_buckets(segments: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Segments unrolled inside their buckets (stored), and what is carried into each bucket of a flow."""
    inside = Window.partitionBy(*FLOW, "_bucket").orderBy("ts", "packet_id")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    syn_seq = F.when(F.col("syn"), F.col("seq"))

    rows = segments.withColumn("_bucket", bucket_of(F.col("ts"), width))
    rows = rows.withColumns(
        {
            "_step": F.coalesce(_signed(F.col("seq") - F.lag("seq").over(inside)), F.lit(0)),
            "_known": F.last(syn_seq, ignorenulls=True).over(before),
            "_first": F.first("seq").over(so_far),
            "_first_syn": F.first(syn_seq, ignorenulls=True).over(so_far),
            "_more": F.lead(F.lit(True), 1, False).over(inside),
        }
    )
    differs = F.col("_known").isNotNull() & (F.col("_known") != F.col("seq"))
    rows = rows.withColumns(
        {
            "_moved": F.sum("_step").over(so_far),
            "_opened": F.sum((F.col("syn") & differs).cast("long")).over(so_far),
            "_syn_seen": F.col("syn") | F.col("_known").isNotNull(),
            "_begins": F.col("syn") & (F.col("_known").isNull() | differs),
            "_size": F.coalesce(F.length("payload"), F.lit(0)),
        }
    )
    # a bucket's last row says what the bucket hands on
    last = {"first_seq": "_first", "last_seq": "seq", "moved": "_moved", "opened": "_opened", "first_syn": "_first_syn"}
    last_syn = F.coalesce(syn_seq, F.col("_known")).alias("last_syn")
    rows = rows.withColumn("_ends", F.when(~F.col("_more"), F.struct(*[F.col(c).alias(n) for n, c in last.items()], last_syn)))
    # decoded, shuffled and sorted once: what follows reads the stored rows, most of it without the payload
    rows = stored(rows.drop("_step", "_known", "_first", "_first_syn", "_more"), "tcp-segments")
    sums = rows.where(F.col("_ends").isNotNull()).select(*FLOW, "_bucket", "_ends.*")
    over = Window.partitionBy(*FLOW).orderBy("_bucket")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    jump = F.coalesce(_signed(F.col("first_seq") - F.lag("last_seq").over(over)) + F.lag("moved").over(over), F.lit(0))
    sums = sums.withColumns({"_jump": jump, "_syn_before": F.last("last_syn", ignorenulls=True).over(earlier)})
    own = F.col("first_syn").isNotNull() & ~F.col("_syn_before").eqNullSafe(F.col("first_syn"))
    sums = sums.withColumn("_own", own.cast("long"))
    carried = sums.select(
        *FLOW,
        "_bucket",
        F.sum("_jump").over(over).alias("_base"),
        F.coalesce(F.sum(F.col("opened") + F.col("_own")).over(earlier), F.lit(0)).alias("_connections"),
        "_own",
    )
    return rows, carried


def _connection() -> Column:
    return F.col("_connections") + F.col("_opened") + F.when(F.col("_syn_seen"), F.col("_own")).otherwise(0)


def unrolled(segments: DataFrame, width: int = WIDTH) -> DataFrame:
    """``segments`` with ``connection`` and ``place``, a byte count that never wraps."""
    rows, carried = _in_buckets(segments, width)
    joined = rows.join(carried, [*FLOW, "_bucket"])
    return joined.select(*segments.columns, _connection().alias("connection"), (F.col("_base") + F.col("_moved")).alias("place"))


def pieces(segments: DataFrame, limit: int | None = None, width: int = WIDTH) -> DataFrame:
    """The payloads cut at the chunks' edges: flow, connection, chunk, at (in the chunk), piece, ts, packet_id.

    With ``limit`` only the first so many bytes of a connection.
    """
    rows, carried = _in_buckets(segments, width)
    rows = rows.withColumn("_from", F.col("_moved") + F.col("syn").cast("long"))
    full = F.col("_size") > 0
    # one row for each connection in a bucket: what it adds to the segments there, and where the connection begins
    local = ["_bucket", "_opened", "_syn_seen"]
    parts = rows.groupBy(*FLOW, *local).agg(F.max(F.when(F.col("_begins"), F.col("_from"))).alias("_syn"), F.min(F.when(full, F.col("_from"))).alias("_least"))
    parts = parts.join(carried, [*FLOW, "_bucket"]).withColumn("connection", _connection())
    syn = F.col("_syn") + F.col("_base")
    start = F.coalesce(F.min_by(syn, F.when(syn.isNotNull(), F.col("_bucket"))), F.min(F.col("_least") + F.col("_base")))
    parts = parts.groupBy(*FLOW, "connection").agg(start.alias("_start"), F.collect_list(F.struct(*local, "_base")).alias("_parts"))
    parts = parts.select(*FLOW, "connection", "_start", F.inline("_parts"))
    # so that the payloads are joined once
    data = rows.where(full).join(parts, [*FLOW, *local])
    data = data.withColumn("_at", F.col("_from") + F.col("_base") - F.col("_start")).withColumn("_end", F.col("_at") + F.col("_size"))
    data = data.where(F.col("_end") > 0)
    if limit is not None:
        data = data.where(F.col("_at") < limit).withColumn("_end", F.least(F.col("_end"), F.lit(limit)))
    first = F.greatest(F.col("_at"), F.lit(0))
    chunks = F.explode(F.sequence(F.expr(f"greatest(_at, 0L) div {CHUNK}"), F.expr(f"(_end - 1) div {CHUNK}")))
    data = data.withColumn("_first", first).withColumn("chunk", chunks)
    low = F.greatest(F.col("_first"), F.col("chunk") * CHUNK)
    high = F.least(F.col("_end"), (F.col("chunk") + 1) * CHUNK)
    piece = F.substring(F.col("payload"), (low - F.col("_at") + 1).cast("int"), (high - low).cast("int"))
    return data.select(*FLOW, "connection", "chunk", (low - F.col("chunk") * CHUNK).cast("int").alias("at"), piece.alias("piece"), "ts", "packet_id")


class _Chunk:
    """Bytes of one chunk, or of a connection's first few, and which of them are there."""

    def __init__(self):
        self.data, self.there = bytearray(), bytearray()

    def put(self, at: int, piece: bytes) -> None:
        """Fill in what is not there yet."""
        i, end, size = at, at + len(piece), len(self.data)
        if end > size:
            new = max(at, size)
            for kept, more in ((self.data, piece[new - at :]), (self.there, b"\x01" * (end - new))):
                kept.extend(bytes(new - size))
                kept.extend(more)
            end = min(end, size)
        while i < end:
            gap = self.there.find(0, i, end)
            if gap < 0:
                return
            i = self.there.find(1, gap, end)
            i = end if i < 0 else i
            self.data[gap:i] = piece[gap - at : i - at]
            self.there[gap:i] = b"\x01" * (i - gap)

    def runs(self) -> Iterator[tuple[int, bytes]]:
        """Stretches without a gap."""
        at = self.there.find(1)
        while at >= 0:
            end = self.there.find(0, at)
            end = len(self.data) if end < 0 else end
            yield at, bytes(self.data[at:end])
            at = self.there.find(1, end)

    def head(self) -> bytes:
        """The bytes up to the first gap."""
        end = self.there.find(0)
        return bytes(self.data if end < 0 else self.data[:end])


def _put_together(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, datetime.datetime, _Chunk]]:
    """Pieces sorted by ``names``, then in order of capture: the values of the names, when they were first seen, the bytes."""
    key, seen, chunk = None, None, None
    for rows in batches:
        size = rows.num_rows
        if not size:
            continue
        columns, changes = [rows.column(n) for n in names], np.zeros(size - 1, bool)
        for c in columns:
            changes |= pc.not_equal(c.slice(1), c.slice(0, size - 1)).to_numpy(zero_copy_only=False)
        begins = [0, *(np.flatnonzero(changes) + 1).tolist()]
        *values, times = [c.take(pa.array(begins)).to_pylist() for c in (*columns, rows.column("ts"))]
        places, parts = rows.column("at").to_pylist(), rows.column("piece").to_pylist()
        for own, ts, begin, end in zip(zip(*values, strict=True), times, begins, [*begins[1:], size], strict=True):
            if own != key:
                if key is not None:
                    yield key, seen, chunk
                key, seen, chunk = own, ts, _Chunk()
            for i in range(begin, end):
                chunk.put(places[i], parts[i])
    if key is not None:
        yield key, seen, chunk


def as_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 100) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of ``size``."""
    for some in itertools.batched(rows, size):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _put_together(batches, [*FLOW, "connection", "chunk"])
    return as_batches(((*own[:5], own[5] * CHUNK + at, data, seen) for own, seen, chunk in found for at, data in chunk.runs()), ARROW)


def head_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of ``heads``, from ``head_pieces`` in a task."""
    for own, seen, chunk in _put_together(batches, [*FLOW, "connection"]):
        yield *own, chunk.head(), seen


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return as_batches(head_rows(batches), HEAD_ARROW)


def streams(packets: DataFrame, limit: int | None = None, where: Column | None = None, width: int = WIDTH) -> DataFrame:
    """The bytes of every connection and direction: ``STREAM``, a row for each stretch of a chunk.

    ``where`` chooses segments by flow before anything is put together.  ``seen`` is when the
    chunk's first segment was captured.  Stretches of neighbouring chunks that meet (offset plus length) belong together.
    """
    segments = tcp_segments(packets)
    cut = pieces(segments if where is None else segments.where(where), limit, width)
    key = [*FLOW, "connection", "chunk"]
    return cut.repartition(*key).sortWithinPartitions(*key, "ts", "packet_id").mapInArrow(_stretches, STREAM)


def head_pieces(packets: DataFrame, limit: int = 4 * CHUNK, where: Column | None = None, width: int = WIDTH) -> DataFrame:
    """The pieces of the first ``limit`` bytes, those of a connection together in order of capture,
    for ``head_rows`` in a function of ``mapInArrow``; ``at`` counts from the beginning of the connection."""
    segments = tcp_segments(packets)
    cut = pieces(segments if where is None else segments.where(where), limit, width)
    cut = cut.withColumn("at", F.col("chunk") * CHUNK + F.col("at")).drop("chunk")
    key = [*FLOW, "connection"]
    return cut.repartition(*key).sortWithinPartitions(*key, "ts", "packet_id")


def heads(packets: DataFrame, limit: int = 4 * CHUNK, where: Column | None = None, width: int = WIDTH) -> DataFrame:
    """The first bytes of every stream up to its first gap, at most ``limit``: flow, connection,
    head, seen (its first segment)."""
    return head_pieces(packets, limit, where, width).mapInArrow(_heads, HEAD)
