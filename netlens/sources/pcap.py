"""Capture files (classic pcap, Ethernet) as packets.

Spark lists the files, through whatever file system the path names (its default one for a path
without scheme).  Large files are read in ranges of about ``split_bytes``.  A first job finds, for
each split, where a record begins: the place from which a long chain of record headers makes
sense.  Records need not lie in order of time; a header's time must lie within ``SPAN`` of the file's
first one.  The search begins a little before the split, so that a chain that was entered by chance
has met the true one there, and ends with the split.  A second job reads every range from its first
record to the next range's; a range that does not end exactly there is an error, so a mistaken place is
never passed over in silence.  No file is walked by one task, and only a few kilobytes are read twice.

``file`` and ``offset`` identify a packet; ``packet_id`` is a 64-bit hash of both and so does not
change when other files arrive.  The interface is the ``iface`` argument or an ``iface=<name>``
folder in the path.

A damaged or cut record is an error that names file and offset.  With ``permissive`` it becomes a
row with ``damage`` set and without ``raw``; the next place where a chain of record headers makes
sense is looked for, and reading goes on there.

Files are opened through pyarrow: local ones (any characters in the path), ``hdfs``, ``s3`` (also
written ``s3a`` or ``s3n``), ``gs`` and ``abfs``.  Any other scheme is an error that says so.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

# Magic numbers of the file header -> (byte order, ticks per second).
MAGIC = {
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
}
FILE_HEADER, RECORD_HEADER, LINK_ETHERNET = 24, 16, 1

BATCH_BYTES = 8 * 1024 * 1024
SPLIT_BYTES = 128 * 1024 * 1024
#: Bytes of a task that reads ranges smaller than that; starting a task takes longer than reading a small range.
TASK_BYTES = 16 * 1024 * 1024
#: No Ethernet capture has longer records; a header that says so is damaged.
MOST_BYTES = 1 << 28
#: Record headers in a row that make a place count as the beginning of a record.
CHAIN = 64
#: Seconds that a file's records lie at most from its first one; a file of which that is not so is read in fewer ranges.
SPAN = 10 * 365 * 86_400
#: Bytes before a split in which the search for its first record begins.
LOOK_BACK = 65_536

PACKETS = "packet_id long, ts timestamp_ntz, iface string, raw binary, file string, offset long, damage string"
ARROW = pa.schema(
    [("ts", pa.timestamp("us")), ("iface", pa.string()), ("raw", pa.binary()), ("file", pa.string()), ("offset", pa.int64()), ("damage", pa.string())]
)
ROWS = "ts timestamp_ntz, iface string, raw binary, file string, offset long, damage string"


class Damaged(ValueError):
    """A record that cannot be read; says where."""


#: Schemes that pyarrow opens, by the name Spark may use for them.
SCHEMES = {"hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it (not escaped), and the path in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), path
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme not in SCHEMES:
        raise ValueError(f"capture files cannot be opened by the scheme {scheme!r}, only by {sorted(SCHEMES)}: {path}")
    return pafs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{quote(rest, safe='/:@?=&')}")


def _open(path: str):
    system, inner = locate(path)
    return system.open_input_file(inner)


def _file_header(stream, path: str) -> tuple[str, int, int]:
    """Byte order, ticks per second, and the longest record that the file announces."""
    head = stream.read(FILE_HEADER)
    if len(head) < FILE_HEADER or head[:4] not in MAGIC:
        raise ValueError(f"not a capture file: {path}")
    order, ticks = MAGIC[head[:4]]
    snaplen, link = struct.unpack(order + "II", head[16:24])
    if link & 0xFFFF != LINK_ETHERNET:
        raise ValueError(f"link type is not Ethernet: {path}")
    return order, ticks, min(snaplen or MOST_BYTES, MOST_BYTES)


def _times(stream, order: str, ticks: int, most: int) -> tuple[int, int] | None:
    """Earliest and latest second of the file's records, by its first one.

    None if that cannot be told, or if fractions of a second would pass as seconds.
    """
    stream.seek(FILE_HEADER)
    head = stream.read(RECORD_HEADER)
    if len(head) < RECORD_HEADER:
        return None
    seconds, fraction, kept, size = struct.unpack(order + "IIII", head)
    if not (fraction < ticks <= seconds - SPAN and 0 < kept <= min(size, most) and size <= MOST_BYTES):
        return None
    return seconds - SPAN, seconds + SPAN


def _is_record(buffer: bytes, at: int, order: str, ticks: int, most: int, whole: bool, times: tuple[int, int] | None = None) -> bool | None:
    """Does a chain of plausible records begin here?  None: the buffer is too short to tell.

    ``whole``: the buffer ends with the file.  Without ``times`` neighbours lie within a week.
    """
    unpack = struct.Struct(order + "IIII").unpack_from
    near = None
    for _ in range(CHAIN):
        if at == len(buffer) and whole:
            return True
        if at + RECORD_HEADER > len(buffer):
            return False if whole else None
        seconds, fraction, kept, size = unpack(buffer, at)
        in_time = times[0] <= seconds <= times[1] if times else near is None or abs(seconds - near) <= 7 * 86_400
        if not (in_time and fraction < ticks and 0 < kept <= min(size, most) and size <= MOST_BYTES):
            return False
        near, at = seconds, at + RECORD_HEADER + kept
    return True


def first_record(path: str, split: int, size: int, until: int | None = None) -> int | None:
    """Offset of the first record that begins at or after ``split`` (and before ``until``); None if none is found."""
    until = size if until is None else min(until, size)
    with _open(path) as stream:
        order, ticks, most = _file_header(stream, path)
        times = _times(stream, order, ticks, most)
        before = split - LOOK_BACK
        if before > FILE_HEADER:
            found = _next_record(stream, order, ticks, most, before, size, times, split)
        else:
            found = FILE_HEADER
        # an earlier record leads here, if its followers do
        while found is not None and found < split:
            stream.seek(found)
            head = stream.read(RECORD_HEADER)
            found = found + RECORD_HEADER + struct.unpack(order + "IIII", head)[2] if len(head) == RECORD_HEADER else None
        if found is not None and found < size and _next_record(stream, order, ticks, most, found, size, times, found + 1) is not None:
            return found if found < until else None
        return _next_record(stream, order, ticks, most, split, size, times, until)


def _records(stream, order: str, ticks: int, path: str, first: int, last: int) -> Iterator[tuple[int, int, int, bytes]]:
    """``(offset, seconds, fraction, frame)`` of the records from ``first`` to exactly ``last``."""
    unpack = struct.Struct(order + "IIII").unpack_from
    stream.seek(first)
    buffer, base, pos = b"", first, 0
    while base + pos < last:
        need = RECORD_HEADER
        if len(buffer) - pos >= need:
            seconds, fraction, kept, size = unpack(buffer, pos)
            if fraction >= ticks or kept > MOST_BYTES or base + pos + need + kept > last:
                raise Damaged(f"damaged or cut record at byte {base + pos} of {path}")
            need += kept
        elif base + pos + need > last:
            raise Damaged(f"damaged or cut record at byte {base + pos} of {path}")
        if len(buffer) - pos < need:
            more = stream.read(min(max(BATCH_BYTES, need), last - base - len(buffer)))
            if not more:
                raise Damaged(f"damaged or cut record at byte {base + pos} of {path}")
            buffer, base, pos = buffer[pos:] + more, base + pos, 0
            continue
        yield base + pos, seconds, fraction, buffer[pos + RECORD_HEADER : pos + need]
        pos += need


def _next_record(
    stream, order: str, ticks: int, most: int, after: int, last: int, times: tuple[int, int] | None, until: int | None = None
) -> int | None:
    """The first place from ``after`` on, and before ``until``, where records begin that make sense up to ``last``."""
    reach, until = 1 << 17, last if until is None else min(until, last)
    while after < until:
        stream.seek(after)
        buffer = stream.read(min(reach, last - after))
        whole = after + len(buffer) >= last
        for at in range(min(len(buffer), until - after)):
            found = _is_record(buffer, at, order, ticks, most, whole, times)
            if found:
                return after + at
            if found is None:
                break
        else:
            return None
        # go on at the place that needs more bytes than were read
        after, reach = after + at, reach if at else reach * 4
    return None


def read_range(path: str, iface: str | None, first: int, last: int, permissive: bool = False) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the records of one file from ``first`` to exactly ``last``."""
    with _open(path) as stream:
        order, ticks, most = _file_header(stream, path)
        times = _times(stream, order, ticks, most) if permissive else None
        rows, held, at = [], 0, first
        while at is not None:
            try:
                for offset, seconds, fraction, frame in _records(stream, order, ticks, path, at, last):
                    rows.append((seconds * 1_000_000 + fraction * 1_000_000 // ticks, frame, offset, None))
                    at = offset + RECORD_HEADER + len(frame)
                    held += len(frame)
                    if held >= BATCH_BYTES:
                        yield _batch(rows, iface, path)
                        rows, held = [], 0
                at = None
            except Damaged as e:
                if not permissive:
                    raise
                rows.append((None, None, at, str(e)))
                at = _next_record(stream, order, ticks, most, at + 1, last, times)
        if rows:
            yield _batch(rows, iface, path)


def _batch(rows: list[tuple], iface: str | None, path: str) -> pa.RecordBatch:
    times, frames, offsets, damage = zip(*rows, strict=True)
    n = len(rows)
    columns = [
        pa.array(times, pa.int64()).cast(pa.timestamp("us")),
        pa.array([iface] * n, pa.string()),
        pa.array(frames, pa.binary()),
        pa.array([path] * n, pa.string()),
        pa.array(offsets, pa.int64()),
        pa.array(damage, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


def list_captures(spark: SparkSession, path: str, iface: str | None = None) -> DataFrame:
    """``file, iface, size`` of the capture files at ``path``; names that start with ``.`` or ``_`` are skipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = F.nullif(F.regexp_extract("path", r"/iface=([^/]+)/", 1), F.lit(""))
    return found.select(F.col("path").alias("file"), F.coalesce(named, F.lit(iface)).alias("iface"), F.col("length").alias("size"))


def capture_ranges(spark: SparkSession, path: str, iface: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``file, iface, first, last``: byte ranges that begin and end with a record."""
    listed = list_captures(spark, path, iface)
    splits = listed.withColumn(
        "split", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes)))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["split"] == 0:
                    with _open(row["file"]) as stream:
                        _file_header(stream, row["file"])
                    first = FILE_HEADER
                else:
                    first = first_record(row["file"], row["split"], row["size"], row["split"] + split_bytes)
                if first is not None:
                    rows.append(row | {"first": first})
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema.append(pa.field("first", pa.int64())))

    pieces = _pieces(splits, F.least(F.col("size") - F.col("split"), F.lit(split_bytes)))
    starts = splits.repartition(pieces, "file", "split").mapInArrow(place, "file string, iface string, size long, split long, first long")
    # the next range's first record, or the end of the file: a window over one file's splits
    distinct = starts.select("file", "iface", "size", "first").distinct()
    after = F.expr("lead(first) over (partition by file order by first)")
    return distinct.withColumn("last", F.coalesce(after, F.col("size"))).select("file", "iface", "first", "last")


def _pieces(rows: DataFrame, size: Column) -> int:
    """Tasks for ranges of so many bytes: one each, but a task of many small ranges takes ``TASK_BYTES``."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    least = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return max(1, min(n, max(least, total // TASK_BYTES)))


def read_captures(
    spark: SparkSession, path: str, iface: str | None = None, split_bytes: int = SPLIT_BYTES, permissive: bool = False
) -> DataFrame:
    """Packets of all capture files at ``path``, large files read in parallel.

    Columns: packet_id, ts, iface, raw, file, offset, damage.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from read_range(row["file"], row["iface"], row["first"], row["last"], permissive)

    # listing and placing run once: counting and reading both take the stored ranges
    ranges = stored(capture_ranges(spark, path, iface, split_bytes).where("first < last"), "ranges")
    packets = ranges.repartition(_pieces(ranges, F.col("last") - F.col("first")), "file", "first").mapInArrow(read, ROWS)
    return packets.select(F.xxhash64("file", "offset").alias("packet_id"), "ts", "iface", "raw", "file", "offset", "damage")


def write_captures(packets: DataFrame, path: str) -> None:
    """Write packets (ts, raw) as capture files, one per task, to a folder that executors reach."""

    def write(number: int, rows) -> None:
        system, inner = locate(path)
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(f"{inner}/capture-{number:06d}.pcap") as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 18, LINK_ETHERNET))
            for micros, raw in rows:
                out.write(struct.pack("<IIII", micros // 1_000_000, micros % 1_000_000, len(raw), len(raw)) + bytes(raw))

    rows = packets.select(F.unix_micros(F.col("ts").cast("timestamp")), "raw")
    rows.rdd.mapPartitionsWithIndex(lambda n, part: [write(n, part)]).count()
