import time
import uuid

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from netlens.operators.logs import LOG_COLUMNS, validate_logs
from netlens.operators.views import log_records
from netlens.plans.fixture import interfaces, packets_raw
from netlens.sources import logtable
from netlens.sources import append_packets, clear_buffer, merge_date, read_buffer, read_packets
from netlens.streaming import Capture, stream_packets

BODY = [c for c in LOG_COLUMNS if c not in ("id", "created_at")]


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("landing") / "frames")
    packets_raw(spark, SF_DIR).repartition(5).write.parquet(path)
    return path


def capture(spark, tmp_path, **options):
    return Capture(spark, f"capture-{uuid.uuid4().hex[:8]}", str(tmp_path / "out"), **options)


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("rules", ["base", "ip"])
def test_stream_equals_batch(spark, tmp_path, landing, rules):
    run = capture(spark, tmp_path, rules=rules)
    run.start(stream_packets(spark, landing, max_files=2), available_now=True).awaitTermination()
    want, rejected = validate_logs(log_records(packets_raw(spark, SF_DIR), rules, keep=["packet_id"]))
    logs = run.logs()
    assert same(logs.select(BODY), want.select(BODY))
    ids = [r["id"] for r in logs.select("id").collect()]
    assert len(set(ids)) == len(ids) == want.count()
    found = run.rejected()
    assert (found.count() if found is not None else 0) == rejected.count() == (0 if rules == "base" else 572)
    assert run.packets().count() == 10_000
    arrival = [tuple(r) for r in run.packets(ordered=True).select("ts", "packet_id").collect()]
    assert arrival == sorted(arrival)


def test_repeated_batch_changes_nothing(spark, tmp_path, landing):
    run = capture(spark, tmp_path)
    run.start(stream_packets(spark, landing, max_files=2), available_now=True).awaitTermination()
    files = sorted((tmp_path / "out" / "checkpoint" / "commits").glob("[0-9]*"))
    files[-1].unlink()  # as if the driver was lost before the last batch was noted
    for crc in (tmp_path / "out" / "checkpoint" / "commits").glob(".*.crc"):
        crc.unlink()
    run.start(stream_packets(spark, landing, max_files=2), available_now=True).awaitTermination()
    assert run.packets().count() == 10_000
    assert run.logs().count() == 3642


def test_a_batch_beyond_the_positions_of_ids_is_not_written(spark, tmp_path, monkeypatch):
    rows = log_records(packets_raw(spark, SF_DIR), "base").persist()
    monkeypatch.setattr(logtable, "MOST_ROWS", 3_641)
    with pytest.raises(ValueError, match="more than 3641 rows"):
        logtable.write_logs(rows, str(tmp_path / "logs"), "s")
    assert not (tmp_path / "logs").exists()
    monkeypatch.setattr(logtable, "MOST_ROWS", 3_642)
    logtable.write_logs(rows, str(tmp_path / "logs"), "s", rejects=str(tmp_path / "rejects"))
    ids = [r["id"] for r in logtable.read_logs(spark, str(tmp_path / "logs")).select("id").collect()]
    assert sorted(ids) == list(range(1, 3_643)) and not (tmp_path / "rejects").exists()
    rows.unpersist()


def test_captures_named_alike_share_a_log(spark, tmp_path, landing):
    """Two captures of one name, one log folder, other writers: nothing is lost."""
    logs = str(tmp_path / "logs")
    for number in (0, 1):
        run = Capture(spark, "same-name", str(tmp_path / f"out-{number}"), logs=logs, writer=number)
        run.start(stream_packets(spark, landing), available_now=True).awaitTermination()
    assert run.logs().count() == 2 * 3642
    assert run.logs().select("id").distinct().count() == 2 * 3642
    third = Capture(spark, "third", str(tmp_path / "out-3"), logs=logs, writer=1)
    with pytest.raises(Exception, match="is taken by"):
        third.start(stream_packets(spark, landing), available_now=True).awaitTermination()


def test_start_is_a_no_op_while_running(spark, tmp_path, landing):
    run = capture(spark, tmp_path, rules="ip")
    run.stop()
    first = run.start(stream_packets(spark, landing), host="10.0.1.2", every="0 seconds")
    try:
        again = run.start(stream_packets(spark, landing), host="10.0.0.9")
        assert again.id == first.id and again.runId == first.runId
        assert run.host == "10.0.0.9"
        first.processAllAvailable()
        assert run.packets().count() == 48
    finally:
        run.stop()
    assert run.query is None
    assert run.packets().count() == 48
    run.clear()
    assert run.packets().count() == 0 and run.logs().count() > 0


def test_snapshot_grows_with_new_files(spark, tmp_path):
    source = str(tmp_path / "in")
    frames = packets_raw(spark, SF_DIR)
    frames.filter("packet_id < 100").write.parquet(source)
    run = capture(spark, tmp_path)
    run.start(stream_packets(spark, source), every="0 seconds")
    try:
        run.query.processAllAvailable()
        assert run.packets().count() == frames.filter("packet_id < 100").count()
        frames.filter("packet_id between 100 and 149").write.mode("append").parquet(source)
        time.sleep(1)
        run.query.processAllAvailable()
        assert run.packets(ordered=False).count() == frames.filter("packet_id < 150").count()
    finally:
        run.stop()


def test_unknown_interface(spark, tmp_path, landing):
    run = capture(spark, tmp_path)
    with pytest.raises(ValueError, match="is not among"):
        run.start(stream_packets(spark, landing), iface="eth7", interfaces=interfaces(spark))
    assert run.query is None


def test_buffer_append_read_clear(spark, tmp_path):
    path = str(tmp_path / "buffer")
    frames = packets_raw(spark, SF_DIR)
    append_packets(frames, path)
    append_packets(frames.limit(0), path)
    append_packets(frames, path, rebalance=True)
    assert read_buffer(spark, path).count() == 20_000
    clear_buffer(spark, path)
    assert read_buffer(spark, path).count() == 0
    append_packets(frames, path, batch="one")
    append_packets(frames, path, batch="one")
    assert read_buffer(spark, path).count() == 10_000


def test_read_packets_options(spark, landing):
    assert read_packets(spark, landing, iface="eth0").count() == 10_000
    for known in (None, interfaces(spark)):
        with pytest.raises(ValueError, match="is not among"):
            read_packets(spark, landing, iface="eth5", interfaces=known)
    longest = read_packets(spark, landing, snaplen=96).selectExpr("max(length(raw)) as n").first()["n"]
    assert longest == 96


def test_nothing_is_cut_unless_asked(spark, tmp_path):
    path = str(tmp_path / "long")
    long = packets_raw(spark, SF_DIR).limit(1).selectExpr("packet_id", "ts", "iface", "cast(repeat('x', 70000) as binary) as raw")
    long.write.parquet(path)
    assert len(read_packets(spark, path).first()["raw"]) == 70_000
    assert len(read_packets(spark, path, snaplen=65_536).first()["raw"]) == 65_536


def test_merge_keeps_the_rows_of_a_date(spark, tmp_path):
    import datetime

    path = str(tmp_path / "buffer")
    frames = packets_raw(spark, SF_DIR)
    for i in range(3):
        append_packets(frames.filter(f"packet_id % 3 = {i}"), path, batch=f"b{i}")
    before = read_buffer(spark, path).drop("batch").collect()
    merge_date(spark, path, datetime.date(2024, 1, 5))
    merge_date(spark, path, datetime.date(1999, 1, 1))
    assert sorted(before, key=lambda r: r["packet_id"]) == sorted(read_buffer(spark, path).drop("batch").collect(), key=lambda r: r["packet_id"])
    names = {p.name for p in (tmp_path / "buffer" / "dt=2024-01-05" / "iface=eth0").iterdir() if p.is_dir()}
    assert names == {"batch=merged"}


def test_a_date_of_a_batch_is_one_file(spark, tmp_path, landing):
    run = capture(spark, tmp_path)
    run.start(stream_packets(spark, landing), available_now=True).awaitTermination()
    assert run.packets().count() == 10_000
    for folder, rows in (("packets", run.packets()), ("logs", run.logs())):
        dates = rows.select(F.to_date("ts" if folder == "packets" else "timestamp")).distinct().count()
        assert dates > 1 and sum(1 for _ in (tmp_path / "out" / folder).rglob("*.parquet")) == dates
