"""A stream over capture files that land, grow and are taken up again."""

import json
import os
import uuid

import pytest
from conftest import SF_DIR
from test_pcap import write_pcap

from netlens.operators.logs import LOG_COLUMNS, validate_logs
from netlens.operators.views import log_records
from netlens.plans.fixture import packets_raw
from netlens.sources import pcap_source
from netlens.sources.pcap_source import CaptureStreamReader, _Options, cut, stream_captures
from netlens.streaming import Capture

BODY = [c for c in LOG_COLUMNS if c not in ("id", "created_at")]


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["ts"], bytes(r["raw"])) for r in packets_raw(spark, SF_DIR).orderBy("packet_id").collect()]


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_capture_of_files_equals_the_batch(spark, tmp_path, rows):
    """Files land, one grows in the middle of a record, the capture ends and goes on."""
    landing = tmp_path / "landing" / "iface=eth0"
    write_pcap(f"{landing}/a.pcap", rows[:4_000])
    whole = open(f"{landing}/a.pcap", "rb").read()
    out = str(tmp_path / "out")
    run = Capture(spark, f"files-{uuid.uuid4().hex[:8]}", out)

    def take():
        source = stream_captures(spark, str(tmp_path / "landing"), f"{out}/source", split_bytes=100_000)
        run.start(source, available_now=True).awaitTermination()
        return run.packets().count()

    open(f"{landing}/a.pcap", "wb").write(whole[:1_000_007])
    first = take()
    assert 0 < first < 4_000
    open(f"{landing}/a.pcap", "wb").write(whole)
    write_pcap(f"{landing}/b.pcap", rows[4_000:], order=">", nano=True)
    open(f"{landing}/c.pcap", "wb").write(whole[:10])  # its header is not there yet
    assert take() == 10_000 and take() == 10_000
    want, _ = validate_logs(log_records(packets_raw(spark, SF_DIR), "base", keep=["packet_id"]))
    assert same(run.logs().select(BODY), want.select(BODY))
    assert run.packets().select("packet_id").distinct().count() == 10_000


def test_a_repeated_step_reads_the_same_bytes(spark, tmp_path, rows):
    write_pcap(str(tmp_path / "in" / "a.pcap"), rows[:500])
    out = tmp_path / "out"
    run = Capture(spark, f"again-{uuid.uuid4().hex[:8]}", str(out))

    def take():
        run.start(stream_captures(spark, str(tmp_path / "in"), f"{out}/source", iface="eth0"), available_now=True).awaitTermination()

    take()
    for path in (out / "checkpoint" / "commits").iterdir():  # as if the driver was lost before the step was noted
        path.unlink()
    write_pcap(str(tmp_path / "in" / "b.pcap"), rows[500:800])
    take()  # the step again, with its own bytes
    assert run.packets().count() == 500
    take()
    assert run.packets().count() == 800
    assert run.packets().select("packet_id").distinct().count() == 800


def reader(folder, log, **options):
    return CaptureStreamReader(_Options({"path": str(folder), **options}), str(log), int(options.get("max_files", 0)) or None)


def test_offsets_are_numbers_and_the_log_is_summed_up(tmp_path, rows, monkeypatch):
    monkeypatch.setattr(pcap_source, "SUMMED_EVERY", 3)
    source = reader(tmp_path / "in", tmp_path / "log")
    os.makedirs(tmp_path / "in")
    assert source.initialOffset() == source.latestOffset() == {"version": 0}
    seen = {}
    for step in range(1, 9):
        write_pcap(str(tmp_path / "in" / f"{step}.pcap"), rows[:step])
        if step == 5:
            source = reader(tmp_path / "in", tmp_path / "log")  # taken up by another process
        assert source.latestOffset() == {"version": step} == source.latestOffset()
        parts = source.partitions({"version": step - 1}, {"version": step})
        assert [os.path.basename(p.file) for p in parts] == [f"{step}.pcap"]
        source.commit({"version": step})
        seen[step] = sum(b.num_rows for p in parts for b in source.read(p))
    assert seen == {i: i for i in range(1, 9)}
    assert sorted(os.listdir(tmp_path / "log")) == ["7.json", "8.json", "sum-6.json"]
    assert len(json.load(open(tmp_path / "log" / "sum-6.json"))) == 6


def test_a_growing_file_is_read_to_its_last_whole_record(tmp_path, rows, monkeypatch):
    monkeypatch.setattr(pcap_source, "TAIL_BYTES", 200_000)
    path = tmp_path / "in" / "a.pcap"
    write_pcap(str(path), rows[:2_000])
    data = path.read_bytes()
    source = reader(tmp_path / "in", tmp_path / "log", split_bytes="50000")
    got, at = [], 0
    for size in (24, 30, 400_000, 400_001, 401_500, len(data) - 1, len(data)):
        path.write_bytes(data[:size])
        version = source.latestOffset()["version"]
        parts = source.partitions({"version": at}, {"version": version})
        got += [r for p in parts for b in source.read(p) for r in b.to_pylist()]
        at = version
    assert [(r["ts"], r["raw"]) for r in got] == rows[:2_000]
    path.write_bytes(data[:1_000])
    with pytest.raises(ValueError, match="became shorter"):
        source.latestOffset()


def test_parts_of_a_range_meet(tmp_path, rows):
    path = str(tmp_path / "a.pcap")
    write_pcap(path, rows[:300])
    size = os.path.getsize(path)
    for split in (1_000, 5_000, 77_777, size):
        parts = cut(path, None, 24, size, split, False)
        assert [r["raw"] for p in parts for b in p.read() for r in b.to_pylist()] == [raw for _, raw in rows[:300]]


def test_files_of_a_step(tmp_path, rows):
    for i in range(5):
        write_pcap(str(tmp_path / "in" / f"{i}.pcap"), rows[: i + 1])
    source = reader(tmp_path / "in", tmp_path / "log", max_files="2")
    assert [source.latestOffset()["version"] for _ in range(5)] == [1, 2, 3, 3, 3]
    parts = [source.partitions({"version": v}, {"version": v + 1}) for v in range(3)]
    assert [len(p) for p in parts] == [2, 2, 1]


def test_the_log_is_asked_for(spark, tmp_path):
    pcap_source.register(spark)
    with pytest.raises(Exception, match="needs the option log"):
        spark.readStream.format("pcap").load(str(tmp_path)).writeStream.format("noop").start().awaitTermination()


def test_small_parts_share_a_task(tmp_path, rows, monkeypatch):
    monkeypatch.setattr(pcap_source, "TASKS", 10)
    write_pcap(str(tmp_path / "in" / "a.pcap"), rows[:2_000])
    write_pcap(str(tmp_path / "in" / "b.pcap"), rows[2_000:2_100])
    source = reader(tmp_path / "in", tmp_path / "log", split_bytes="10000")
    tasks = source.partitions({"version": 0}, source.latestOffset())
    assert len(tasks) <= 14 and max(len(t.parts) for t in tasks) > 5
    assert all(t.file == p.file for t in tasks for p in t.parts)
    got = [(r["ts"], r["raw"]) for t in tasks for b in source.read(t) for r in b.to_pylist()]
    assert got == rows[:2_100]


def test_the_end_of_a_file_out_of_order_in_time(tmp_path, rows, monkeypatch):
    """The last whole record is found near the file's end, with no walk from its beginning."""
    monkeypatch.setattr(pcap_source, "TAIL_BYTES", 200_000)
    mixed = rows[::2] + rows[1::2]
    mixed = [mixed[i * 7 % len(mixed)] for i in range(2_001)]
    path = str(tmp_path / "a.pcap")
    write_pcap(path, mixed)
    size, tried = os.path.getsize(path), []
    real = pcap_source._is_record
    monkeypatch.setattr(pcap_source, "_is_record", lambda *a: tried.append(1) or real(*a))
    assert pcap_source.whole_end(path, 24, size - 1, False) == size - 16 - len(mixed[-1][1])
    assert len(tried) < 5_000


def test_a_batch_of_many_parts_is_written_in_few_files(spark, tmp_path, rows, monkeypatch):
    from netlens.streaming import capture

    monkeypatch.setattr(capture, "TASKS_PER_CORE", 1)
    write_pcap(str(tmp_path / "in" / "a.pcap"), rows)
    run = Capture(spark, f"few-{uuid.uuid4().hex[:8]}", str(tmp_path / "out"))
    run.start(stream_captures(spark, str(tmp_path / "in"), str(tmp_path / "log"), iface="eth0", split_bytes=20_000), available_now=True).awaitTermination()
    assert run.packets().count() == len(rows)
    dates = run.packets().select("dt").distinct().count()
    files = sum(f.endswith(".parquet") for _, _, names in os.walk(tmp_path / "out" / "packets") for f in names)
    assert files <= dates * spark.sparkContext.defaultParallelism
