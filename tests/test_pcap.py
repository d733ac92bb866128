import datetime
import os
import random
import struct

import pytest
from conftest import SF_DIR

from netlens.operators.decode import fields
from netlens.plans.fixture import packets_raw
from netlens.sources import pcap, scan_captures
from netlens.sources.pcap import capture_ranges, list_captures, read_captures, write_captures

EPOCH = datetime.datetime(1970, 1, 1)


def write_pcap(path, records, order="<", nano=False, link=1):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    scale = 1000 if nano else 1
    with open(path, "wb") as f:
        f.write(struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65536, link))
        for ts, frame in records:
            micros = (ts - EPOCH) // datetime.timedelta(microseconds=1)
            head = (micros // 1_000_000, micros % 1_000_000 * scale, len(frame), len(frame))
            f.write(struct.pack(order + "IIII", *head) + frame)


@pytest.fixture(scope="module")
def captures(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("captures"))
    rows = [(r["ts"], bytes(r["raw"])) for r in packets_raw(spark, SF_DIR).orderBy("packet_id").collect()]
    write_pcap(f"{root}/iface=eth0/a.pcap", rows[:6000])
    write_pcap(f"{root}/iface=eth0/b.pcap", rows[6000:7000], order=">")
    write_pcap(f"{root}/iface=eth1/c.pcap", rows[7000:], nano=True)
    write_pcap(f"{root}/iface=eth1/empty.pcap", [])
    open(f"{root}/_SUCCESS", "w").close()
    return root, rows


def content(df):
    return sorted((r["ts"], bytes(r["raw"])) for r in df.select("ts", "raw").collect())


def test_listing(spark, captures):
    names = sorted(os.path.basename(r["file"]) for r in list_captures(spark, captures[0]).collect())
    assert names == ["a.pcap", "b.pcap", "c.pcap", "empty.pcap"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        list_captures(spark, "/tmp/no-such-folder-here").collect()


def test_uri_paths(spark, captures):
    root, rows = captures
    assert content(read_captures(spark, f"file://{root}", split_bytes=300_000)) == sorted(rows)


def test_a_new_file_changes_no_id(spark, captures, tmp_path):
    rows = captures[1]
    folder = str(tmp_path / "growing")
    write_pcap(f"{folder}/b.pcap", rows[:50])
    before = {(r["ts"], bytes(r["raw"])): r["packet_id"] for r in read_captures(spark, folder).collect()}
    write_pcap(f"{folder}/a.pcap", rows[50:90])
    after = read_captures(spark, folder)
    assert {(r["ts"], bytes(r["raw"])): r["packet_id"] for r in after.filter("file like '%b.pcap'").collect()} == before
    assert after.select("packet_id").distinct().count() == after.select("file", "offset").distinct().count() == 90


def test_written_captures_come_back(spark, captures, tmp_path):
    frames = packets_raw(spark, SF_DIR)
    folder = str(tmp_path / "written")
    write_captures(frames.repartition(4), folder)
    assert content(read_captures(spark, folder, split_bytes=200_000)) == sorted(captures[1])


def test_a_capture_inside_a_capture(spark, captures, tmp_path):
    """Frames whose payload looks like records: either read rightly or refused, never wrongly."""
    rows = captures[1][:40]
    inner = b"".join(struct.pack("<IIII", 1_700_000_000, 5, len(f), len(f)) + f for _, f in rows)
    outer = [(ts, b"h" * 54 + inner[i * 1_400 : i * 1_400 + 1_400]) for i, (ts, _) in enumerate(rows * 20)]
    folder = str(tmp_path / "nested")
    write_pcap(f"{folder}/x.pcap", outer)
    try:
        got = content(read_captures(spark, folder, split_bytes=9_000))
    except Exception as e:
        assert "damaged or cut record" in str(e)
    else:
        assert got == sorted(outer)
    assert content(read_captures(spark, folder)) == sorted(outer)


@pytest.mark.parametrize("split_bytes", [100_000, 1_000_000, 10**12])
def test_split_reading(spark, captures, split_bytes):
    root, rows = captures
    df = read_captures(spark, root, split_bytes=split_bytes)
    assert content(df) == sorted(rows)
    pieces = capture_ranges(spark, root, split_bytes=split_bytes).count()
    assert pieces == 4 if split_bytes == 10**12 else pieces > 4
    whole = read_captures(spark, root)
    assert df.select("packet_id").exceptAll(whole.select("packet_id")).isEmpty()


def test_decode_from_captures(spark, captures):
    df = fields(read_captures(spark, captures[0], split_bytes=500_000))
    assert df.filter("arp_op is not null").count() == 500
    assert df.filter("ipv6_next_header is not null").count() == 2000


def test_damage_is_an_error_or_a_row(spark, tmp_path):
    path = str(tmp_path / "x" / "cut.pcap")
    ts = datetime.datetime(2024, 1, 1, 0, 0, 0, 123456)
    write_pcap(path, [(ts, b"a" * 60), (ts, b"b" * 60)])
    with open(path, "r+b") as f:
        f.truncate(os.path.getsize(path) - 10)
    with pytest.raises(Exception, match=r"damaged or cut record at byte 100 of .*cut.pcap"):
        read_captures(spark, path, iface="eth9").count()
    df = read_captures(spark, path, iface="eth9", permissive=True)
    assert content(df.filter("damage is null")) == [(ts, b"a" * 60)]
    bad = df.filter("damage is not null").first()
    assert (bad["offset"], bad["raw"], bad["iface"]) == (100, None, "eth9")


def test_damaged_length_in_the_middle(spark, tmp_path):
    path = str(tmp_path / "y" / "bad.pcap")
    ts = datetime.datetime(2024, 1, 1)
    write_pcap(path, [(ts, bytes([i]) * 60) for i in range(10)])
    with open(path, "r+b") as f:
        f.seek(24 + 3 * 76 + 8)
        f.write(struct.pack("<I", 0x7FFFFFFF))
    for read in (read_captures, scan_captures):
        with pytest.raises(Exception, match="damaged or cut record at byte 252"):
            read(spark, path).count()
        df = read(spark, path, permissive=True)
        assert content(df.filter("damage is null")) == [(ts, bytes([i]) * 60) for i in range(10) if i != 3]
        assert [r["offset"] for r in df.filter("damage is not null").collect()] == [252]


def test_damage_loses_one_record_of_many(spark, captures, tmp_path):
    rows = captures[1][:3_000]
    path = str(tmp_path / "many" / "x.pcap")
    write_pcap(path, rows)
    places = [r["offset"] for r in read_captures(spark, path).select("offset").orderBy("offset").collect()]
    hit = [500, 501, 1_700]
    with open(path, "r+b") as f:
        for i in hit:
            f.seek(places[i] + 4)
            f.write(b"\xff" * 12)
    want = sorted(r for i, r in enumerate(rows) if i not in hit)
    for split_bytes in (10**9, 300_000):
        df = read_captures(spark, path, split_bytes=split_bytes, permissive=True)
        assert content(df.filter("damage is null")) == want
        # two damaged records in a row are one stretch
        assert sorted(r["offset"] for r in df.filter("damage is not null").collect()) == [places[500], places[1_700]]


def test_paths_with_spaces_and_signs(spark, captures, tmp_path):
    rows = captures[1][:200]
    folder = str(tmp_path / "a folder (1) 50% é#x")
    write_pcap(f"{folder}/my capture?.pcap", rows)
    for read in (read_captures, scan_captures):
        assert content(read(spark, folder)) == sorted(rows)
    other = f"{folder}/written here"
    write_captures(read_captures(spark, folder), other)
    assert content(scan_captures(spark, other)) == sorted(rows)


def test_other_file_systems(monkeypatch):
    asked = []
    monkeypatch.setattr(pcap, "pafs", type("fs", (), {"FileSystem": type("F", (), {"from_uri": staticmethod(lambda u: asked.append(u) or (None, u))})}))
    pcap.locate("s3a://bucket/a b.pcap")
    pcap.locate("hdfs://host:8020/x#y/z.pcap")
    assert asked == ["s3://bucket/a%20b.pcap", "hdfs://host:8020/x%23y/z.pcap"]
    with pytest.raises(ValueError, match="cannot be opened by the scheme 'viewfs'"):
        pcap.locate("viewfs://cluster/x.pcap")


@pytest.mark.parametrize("split_bytes", [100_000, 10**12])
def test_the_data_source_reads_the_same(spark, captures, split_bytes):
    root, _ = captures
    a, b = read_captures(spark, root), scan_captures(spark, root, split_bytes=split_bytes)
    assert a.columns == b.columns
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    with pytest.raises(Exception, match="no capture files at"):
        scan_captures(spark, "/tmp/no-such-folder-here").collect()


def test_bad_files_are_errors(spark, tmp_path):
    other = str(tmp_path / "a" / "radio.pcap")
    write_pcap(other, [], link=105)
    with pytest.raises(Exception, match="not Ethernet"):
        read_captures(spark, other).count()
    text = tmp_path / "b.pcap"
    text.write_text("this is no capture file, only text")
    with pytest.raises(Exception, match="not a capture file"):
        read_captures(spark, str(text)).count()


def spans_of_records(path, rows):
    """Offsets at which the records of ``rows`` begin."""
    places = [24]
    for _, frame in rows:
        places.append(places[-1] + 16 + len(frame))
    return places[:-1]


def test_records_out_of_order_in_time(spark, captures, tmp_path):
    """Neighbours weeks apart: every split finds its record near by, and none looks through the file."""
    rows = list(captures[1])
    random.Random(3).shuffle(rows)
    path = str(tmp_path / "mixed" / "x.pcap")
    write_pcap(path, rows)
    places, size = spans_of_records(path, rows), os.path.getsize(path)
    for split in range(300_000, size, 300_000):
        assert pcap.first_record(path, split, size, split + 300_000) == min(p for p in places if p >= split)
    assert capture_ranges(spark, path, split_bytes=300_000).count() == -(-size // 300_000)
    for read in (read_captures, scan_captures):
        assert content(read(spark, path, split_bytes=300_000)) == sorted(rows)
    with open(path, "r+b") as f:
        f.seek(places[4_000] + 4)
        f.write(b"\xff" * 12)
    df = read_captures(spark, path, permissive=True)
    assert content(df.where("damage is null")) == sorted(r for i, r in enumerate(rows) if i != 4_000)


def test_the_search_ends_with_its_split(tmp_path):
    """Nothing but bytes that are no records behind the first one: the next splits find nothing, and say so."""
    path = str(tmp_path / "zeros.pcap")
    write_pcap(path, [(datetime.datetime(2024, 1, 1), b"\0" * 2_000_000)])
    size = os.path.getsize(path)
    looked = []
    real, pcap._is_record = pcap._is_record, lambda *a, **b: looked.append(1) or real(*a, **b)
    try:
        assert pcap.first_record(path, 500_000, size, 510_000) is None
    finally:
        pcap._is_record = real
    assert len(looked) <= 10_000 + pcap.LOOK_BACK


def test_a_chain_entered_by_chance_meets_the_true_one(tmp_path):
    """Bytes that look like a header and lead to a true record: not taken if they lie before the split's first record."""
    ts = datetime.datetime(2024, 1, 1)
    false = struct.pack("<IIII", 1_704_067_200, 0, 1_000 - 116, 1_000 - 116)
    rows = [(ts, b"p" * 100 + false + b"q" * (1_000 - 116)) for _ in range(400)]
    path = str(tmp_path / "led.pcap")
    write_pcap(path, rows)
    places, size = spans_of_records(path, rows), os.path.getsize(path)
    for split in (places[200] + 1, places[200] + 110, places[200] + 116, places[201]):
        assert pcap.first_record(path, split, size) == places[201]


def test_many_small_ranges_share_a_task(spark, captures):
    df = read_captures(spark, captures[0], split_bytes=20_000)
    assert df.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert content(df) == sorted(captures[1])
