"""Pages that begin behind a place, and what they read."""

import re

from conftest import SF_DIR

from netlens.operators.views import log_records
from netlens.plans.fixture import packets_raw
from netlens.sources import append_packets, end_of, log_page, packet_page, packets_since, read_buffer, write_logs
from netlens.sources.paging import buffer_dates


def test_pages_walk_the_buffer(spark, tmp_path):
    path = str(tmp_path / "buffer")
    frames = packets_raw(spark, SF_DIR).where("packet_id < 1500")
    append_packets(frames, path)
    append_packets(frames.where("packet_id < 20").selectExpr("packet_id + 5000 as packet_id", "ts", "iface", "raw"), path)  # equal times
    want = [(r["ts"], r["packet_id"]) for r in read_buffer(spark, path, ordered=True).select("ts", "packet_id").collect()]
    got, cursor = [], None
    for _ in range(5):
        page = packet_page(spark, path, cursor, 400)
        got += [(r["ts"], r["packet_id"]) for r in page.select("ts", "packet_id").collect()]
        cursor = end_of(page) or cursor
    assert got == want and len(want) == 1_520
    assert end_of(packet_page(spark, path, cursor, 400)) is None
    assert packet_page(spark, str(tmp_path / "none")).count() == 0


def test_rows_that_arrive_shift_nothing_and_other_dates_are_not_read(spark, tmp_path):
    path = str(tmp_path / "buffer")
    frames = packets_raw(spark, SF_DIR)
    append_packets(frames.where("ts < timestamp_ntz'2024-01-04'"), path)
    first = end_of(packet_page(spark, path, None, 50))
    second = [r["packet_id"] for r in packet_page(spark, path, first, 50).collect()]
    append_packets(frames.where("ts >= timestamp_ntz'2024-01-04'"), path)
    append_packets(frames.limit(1).selectExpr("-1L as packet_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "iface", "raw"), path)
    page = packet_page(spark, path, first, 50)
    assert [r["packet_id"] for r in page.collect()] == second
    assert len(buffer_dates(spark, path)) == 30
    assert {re.search(r"dt=([\d-]+)", f)[1] for f in page.inputFiles()} == {"2024-01-01"}


def test_log_pages_push_the_bound(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = log_records(packets_raw(spark, SF_DIR), "base").persist()
    for batch in range(2):
        write_logs(rows, path, "s", batch)
    ids, last = [], 0
    while True:
        page = [r["id"] for r in log_page(spark, path, last, 3_000).select("id").collect()]
        if not page:
            break
        ids, last = ids + page, page[-1]
    assert ids == sorted(ids) and len(ids) == 2 * 3_642
    plan = log_page(spark, path, 5, 10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan and "TakeOrdered" in plan
    rows.unpersist()


def test_since_a_batch(spark, tmp_path):
    path = str(tmp_path / "buffer")
    frames = packets_raw(spark, SF_DIR)
    for i in range(12):
        append_packets(frames.where(f"packet_id % 12 = {i}"), path, batch=f"query-a-{i}")
    append_packets(frames.limit(3), path, batch="other-50")
    append_packets(frames.limit(3), path)
    new = packets_since(spark, path, "query-a", 9)
    assert new.count() == frames.where("packet_id % 12 > 9").count()
    assert packets_since(spark, path, "query-a").count() == 10_000
    plan = new.select("packet_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "regexp_extract(batch" in re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)[1]
