"""Capture files as a Spark data source, ``format("pcap")``, for batches and for streams.

A stream follows a folder of capture files, also files that are still being written.  What it
takes in a step is a byte range of each file that grew: from where the last step ended to the end of
the last whole record.  The driver looks at the end of such a file only (the last few megabytes, to
find that record); reading, and finding where a large range may be cut, is done by tasks.

An offset of the stream is a number.  The ranges it stands for are a small file under ``log``,
written before Spark notes the offset, so a step that is repeated reads exactly the same bytes,
and the offset does not grow with the number of files.  From time to time the log is summed up
in one file; what is older goes when Spark has committed it.  One stream has one ``log``.

A file that became shorter is an error.  A file whose header is not written yet waits.

Options: ``iface`` (else an ``iface=<name>`` folder of the path), ``split_bytes``, ``permissive``,
for streams also ``log`` and ``max_files`` (files that one step takes; all without it).  A
trigger ``availableNow`` takes one step, or repeats one: a Python source of Spark 4.1 cannot tell
that more is there.
"""

from __future__ import annotations

import contextlib
import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.filters import truncate_snaplen
from .pcap import (
    FILE_HEADER,
    MOST_BYTES,
    RECORD_HEADER,
    ROWS,
    SPLIT_BYTES,
    TASK_BYTES,
    Damaged,
    _file_header,
    _is_record,
    _open,
    _times,
    first_record,
    locate,
    read_range,
)

#: Bytes at the end of a file in which the last whole record is looked for.
TAIL_BYTES = 4 * 1024 * 1024
#: Steps after which the log is summed up.
SUMMED_EVERY = 20
#: Tasks of a step from which on small neighbouring parts share one.
TASKS = 256


@dataclass
class CaptureRange(InputPartition):
    """Bytes of one file; an end that is no record's end moves on to the next record."""

    file: str
    iface: str | None
    low: int
    high: int
    end: int  # of the whole range that this is a part of
    permissive: bool
    exact: int = FILE_HEADER  # beginning of that range

    def read(self) -> Iterator[pa.RecordBatch]:
        first = self._placed(self.low, self.high)
        if first is not None and first < self.end:
            last = self._placed(self.high)
            yield from read_range(self.file, self.iface, first, self.end if last is None else last, self.permissive)

    def _placed(self, at: int, until: int | None = None) -> int | None:
        """The first record from there on; without one before ``until`` the part is read with an earlier one."""
        return at if at in (self.exact, self.end) else first_record(self.file, at, self.end, until)


def cut(file: str, iface: str | None, first: int, last: int, split_bytes: int, permissive: bool) -> list[CaptureRange]:
    """A range in parts of about ``split_bytes``."""
    edges = [*range(first, last, split_bytes), last]
    return [CaptureRange(file, iface, a, b, last, permissive, first) for a, b in zip(edges, edges[1:])]


@dataclass
class Neighbours(InputPartition):
    """Parts of one file that one task reads one after another."""

    parts: list[CaptureRange]

    @property
    def file(self) -> str:
        return self.parts[0].file

    def read(self) -> Iterator[pa.RecordBatch]:
        for part in self.parts:
            yield from part.read()


def dealt(parts: list[CaptureRange]) -> list[Neighbours]:
    """Parts as tasks: each its own, unless there are more than ``TASKS`` of less than ``TASK_BYTES``."""
    most = min(TASK_BYTES, sum(p.high - p.low for p in parts) // TASKS)
    tasks: list[Neighbours] = []
    for part in parts:
        if tasks and tasks[-1].file == part.file and part.high - tasks[-1].parts[0].low <= most:
            tasks[-1].parts.append(part)
        else:
            tasks.append(Neighbours([part]))
    return tasks


def whole_end(path: str, at: int, size: int, permissive: bool) -> int:
    """End of the last whole record of the file's first ``size`` bytes; one ends at ``at``."""
    with _open(path) as stream:
        order, ticks, most = _file_header(stream, path)
        unpack = struct.Struct(order + "IIII").unpack_from
        if size - at > TAIL_BYTES:
            stream.seek(size - TAIL_BYTES)
            buffer, times = stream.read(TAIL_BYTES), _times(stream, order, ticks, most)
            tail = (i for i in range(TAIL_BYTES // 2) if _is_record(buffer, i, order, ticks, most, False, times))
            at = next((size - TAIL_BYTES + i for i in tail), at)
        stream.seek(at)
        while at + RECORD_HEADER <= size:
            _, fraction, kept, _ = unpack(stream.read(RECORD_HEADER))
            if fraction >= ticks or kept > MOST_BYTES:
                if permissive:
                    return size
                raise Damaged(f"damaged or cut record at byte {at} of {path}")
            if at + RECORD_HEADER + kept > size:
                break
            at += RECORD_HEADER + kept
            stream.seek(at)
        return at


class _Options:
    """What both readers take from the options."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.iface = options.get("iface")
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.permissive = options.get("permissive", "false").lower() == "true"

    def listed(self) -> list[tuple[str, int]]:
        """Capture files and their sizes, by name."""
        system, root = locate(self.path)
        info = system.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"no capture files at {self.path}")
        found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(root, recursive=True))
        base = f"file:{root}" if isinstance(system, pafs.LocalFileSystem) else self.path
        names = [(base.rstrip("/") + f.path[len(root.rstrip("/")) :], f.size) for f in found if f.is_file and f.base_name[0] not in "._"]
        return sorted(names)

    def interface(self, file: str) -> str | None:
        named = re.search(r"/iface=([^/]+)/", file)
        return named[1] if named else self.iface


class CaptureReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        o = self.options
        # at least one range of each file, so that a file that is none is found out
        sizes = [(file, max(size, FILE_HEADER + 1)) for file, size in o.listed()]
        return dealt([part for file, size in sizes for part in cut(file, o.interface(file), FILE_HEADER, size, o.split_bytes, o.permissive)])

    def read(self, partition: Neighbours) -> Iterator[pa.RecordBatch]:
        with _open(partition.file) as stream:
            _file_header(stream, partition.file)
            end = stream.size()
        for part in partition.parts:
            part.end, part.high = end, min(part.high, end)
        yield from partition.read()


class CaptureStreamReader(DataSourceStreamReader):
    def __init__(self, options: _Options, log: str, max_files: int | None = None):
        self.options, self.max_files = options, max_files
        self.system, self.log = locate(log)
        self.system.create_dir(self.log, recursive=True)
        self.state: dict[str, int] | None = None  # end of what was taken of each file
        self.version = 0

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        if self.state is None:
            self._load()
        taken: dict[str, list[int]] = {}
        for file, size in self.options.listed():
            at = self.state.get(file, FILE_HEADER)
            if size < at and file in self.state:
                raise ValueError(f"capture file became shorter: {file} had {at} bytes, has {size}")
            if size > at:
                end = whole_end(file, at, size, self.options.permissive)
                if end > at:
                    taken[file] = [at, end]
            if len(taken) == self.max_files:
                break
        if taken:
            self.version += 1
            self._write(f"{self.version}.json", taken)
            self.state.update({file: end for file, (_, end) in taken.items()})
            if self.version % SUMMED_EVERY == 0:
                self._write(f"sum-{self.version}.json", self.state)
        return {"version": self.version}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        o, parts = self.options, []
        for version in range(start["version"] + 1, end["version"] + 1):
            for file, (first, last) in self._read(f"{version}.json").items():
                parts += cut(file, o.interface(file), first, last, o.split_bytes, o.permissive)
        return dealt(parts)

    def read(self, partition: Neighbours) -> Iterator[pa.RecordBatch]:
        yield from partition.read()

    def commit(self, end: dict) -> None:
        names = self._names()
        sums = [v for kind, v in names if kind == "sum-" and v <= end["version"]]
        for kind, version in names:
            if sums and (version <= max(sums) if not kind else version < max(sums)):
                with contextlib.suppress(FileNotFoundError):
                    self.system.delete_file(f"{self.log}/{kind}{version}.json")

    def _names(self) -> list[tuple[str, int]]:
        found = self.system.get_file_info(pafs.FileSelector(self.log))
        named = (re.fullmatch(r"(sum-|)(\d+)\.json", f.base_name) for f in found)
        return sorted((m[1], int(m[2])) for m in named if m)

    def _load(self) -> None:
        names = self._names()
        summed = max((v for kind, v in names if kind), default=0)
        self.state = self._read(f"sum-{summed}.json") if summed else {}
        later = [v for kind, v in names if not kind and v > summed]
        for version in later:
            self.state.update({file: end for file, (_, end) in self._read(f"{version}.json").items()})
        self.version = max([summed, *later])

    def _read(self, name: str) -> dict:
        with self.system.open_input_stream(f"{self.log}/{name}") as f:
            return json.loads(f.read())

    def _write(self, name: str, value: dict) -> None:
        """Whole or not at all: written beside its place, then moved there."""
        with self.system.open_output_stream(f"{self.log}/.{name}") as f:
            f.write(json.dumps(value).encode())
        self.system.move(f"{self.log}/.{name}", f"{self.log}/{name}")


class CaptureSource(DataSource):
    """``format("pcap")``."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(_Options(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        if "log" not in self.options:
            raise ValueError("a stream of capture files needs the option log: a folder of its own that outlives it")
        return CaptureStreamReader(_Options(self.options), self.options["log"], int(self.options.get("max_files", 0)) or None)


def register(spark: SparkSession) -> None:
    """Make ``format("pcap")`` known to the session."""
    spark.dataSource.register(CaptureSource)


def _packets(rows: DataFrame, snaplen: int | None = None) -> DataFrame:
    named = rows.select(F.xxhash64("file", "offset").alias("packet_id"), *rows.columns)
    return truncate_snaplen(named, snaplen)


def scan_captures(spark: SparkSession, path: str, **options) -> DataFrame:
    """The packets of ``sources.pcap.read_captures``, planned by the driver without a job."""
    register(spark)
    return _packets(spark.read.format("pcap").options(**options).load(path))


def stream_captures(spark: SparkSession, path: str, log: str, snaplen: int | None = None, **options) -> DataFrame:
    """Packets of the capture files that land or grow at ``path``; give it to ``Capture.start``."""
    register(spark)
    return _packets(spark.readStream.format("pcap").options(log=log, **options).load(path), snaplen)
