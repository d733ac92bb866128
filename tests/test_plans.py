"""What the physical plans must and must not contain."""

import hashlib
import re

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from netlens.operators import rules
from netlens.operators.arp import arp_untrusted
from netlens.operators.decode import decode, fields
from netlens.operators.enrich import Lookups, enrich_both_ends, enrich_ip
from netlens.operators.filters import host_filter, host_set_filter
from netlens.operators.keyed import key_exists
from netlens.operators.views import log_records, packet_view, readable_payload
from netlens.plans.catalog import QUERIES
from netlens.plans.fixture import hosts, lookups, packets_raw
from netlens.sources import append_packets, read_buffer


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "packets")
    append_packets(packets_raw(spark, SF_DIR), path)
    return read_buffer(spark, path)


def test_no_python_in_decode_rules_and_views(spark):
    df = packets_raw(spark, SF_DIR)
    for result in (
        decode(df), rules.flag(df, "base"), rules.flag(df, "ip"), packet_view(df), readable_payload(df),
        log_records(df, "base"), log_records(df, "ip"),
    ):
        assert "Python" not in plan(result)


def test_no_shuffle_from_packets_to_logs(spark):
    df = packets_raw(spark, SF_DIR)
    for name in ("base", "ip"):
        assert "Exchange" not in plan(log_records(df, name))


def test_known_macs_are_broadcast(spark):
    text = plan(arp_untrusted(packets_raw(spark, SF_DIR)))
    assert text.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in text


def test_small_lookups_are_broadcast(spark):
    df = fields(packets_raw(spark, SF_DIR)).withColumn("ip", F.coalesce("ipv4_src", "ipv6_src"))
    text = plan(enrich_ip(df, "ip", lookups(spark, SF_DIR)).select("packet_id", "geoData", "domainName"))
    assert "SortMergeJoin" not in text and "BroadcastNestedLoopJoin" not in text
    assert "CartesianProduct" not in text


def test_host_filter_reaches_the_scan(stored):
    text = plan(host_filter(stored, "10.0.1.2").select("packet_id"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "EqualTo(src_ip,10.0.1.2)" in pushed and "EqualTo(dst_ip,10.0.1.2)" in pushed
    assert "raw" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_rules_on_stored_packets_read_headers_only(stored):
    text = plan(rules.anomalies(stored, "ip").select("packet_id"))
    read = re.search(r"ReadSchema: (.*)", text).group(1)
    assert "raw" not in read and "payload" not in read and "eth" not in read
    assert "Generate" not in text


def test_time_and_interface_filters_pass_the_decode(spark):
    df = fields(packets_raw(spark, SF_DIR)).filter(
        "iface = 'eth0' and ts > timestamp_ntz'2024-01-02 00:00:00' and tcp_dst_port = 443"
    )
    text = plan(df.select("packet_id"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "EqualTo(iface,eth0)" in pushed and "GreaterThan(ts" in pushed


def test_partitions_are_pruned(stored):
    text = plan(stored.filter("dt = date'2024-01-05' and iface = 'eth0'").select("packet_id"))
    assert re.search(r"PartitionFilters: \[.*dt.*iface.*\]", text)


def test_decode_is_computed_once(spark):
    text = plan(fields(packets_raw(spark, SF_DIR)).filter("tcp_dst_port = 443").select("packet_id"))
    assert text.count("conv(") < 30


def packet_scans(df) -> int:
    """How often the plan that would run reads frames (the files with a column ``raw``)."""
    return len(re.findall(r"FileScan parquet [^\n]*raw:binary", plan(df)))


@pytest.mark.parametrize("strategy", [None, "merge"])
def test_joins_read_packets_once(spark, strategy):
    frames, tables = packets_raw(spark, SF_DIR), lookups(spark, SF_DIR)
    rows = log_records(frames, "base", keep=["packet_id"])
    assert packet_scans(enrich_both_ends(rows, tables, spread_by="packet_id", strategy=strategy)) == 1
    assert packet_scans(host_set_filter(frames, hosts(spark, SF_DIR), strategy=strategy)) == 1
    text = plan(key_exists(frames.select("packet_id"), spark.range(9), "packet_id", "id", "packet_id", strategy=strategy))
    assert text.count("FileScan parquet") == 1


def test_large_lookup_gets_no_hint(spark, tmp_path):
    """Text that compresses well looks small before it is read; nothing here vouches for it."""
    path = str(tmp_path / "whois")
    spark.range(20_000).selectExpr("concat('10.0.', id div 250, '.', id % 250) as ip", "repeat('inetnum line ', 200) as whois").write.parquet(path)
    whois = spark.read.parquet(path)
    tables = lookups(spark, SF_DIR)
    df = fields(packets_raw(spark, SF_DIR)).withColumn("ip", F.coalesce("ipv4_src", "ipv6_src"))
    rich = enrich_ip(df, "ip", Lookups(tables.ptr, whois, tables.geo))
    assert "ResolvedHint" not in rich._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint" not in rich._jdf.queryExecution().optimizedPlan().toString()


def test_a_date_lists_that_date_only(spark, tmp_path):
    path = str(tmp_path / "dated")
    append_packets(packets_raw(spark, SF_DIR), path, batch="b")
    df = read_buffer(spark, path).filter("dt = date'2024-01-05'")
    assert df.inputFiles() and re.search(r"PartitionFilters: \[[^]]*dt#\d+ = 2024-01-05", plan(df.select("packet_id")))
    top = {p.name for p in (tmp_path / "dated").iterdir() if p.is_dir()}
    assert all(name.startswith("dt=") for name in top) and len(top) == 30


def test_host_set_is_two_broadcast_joins(spark):
    text = plan(host_set_filter(packets_raw(spark, SF_DIR), hosts(spark, SF_DIR)).select("packet_id"))
    assert text.count("BroadcastHashJoin") == 2 and "NestedLoop" not in text


def read_batches(node) -> int:
    """Batches that the scans of a plan gave, once it has run."""
    own = node.metrics().get("numInputBatches")
    below = [node.children().apply(i) for i in range(node.children().size())]
    return (own.get().value() if own.isDefined() else 0) + sum(map(read_batches, below))


def test_long_frames_are_read_in_small_batches(spark, tmp_path):
    """The reader holds a batch in one array: 300 frames of 70 kB in each of eight files are not one batch each."""
    text = F.concat(F.lit("document "), F.col("id").cast("string"), F.lit(" \u00e9"))
    spark.range(2400).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["long_frames"](spark, str(tmp_path))
    found = {r["doc_id"]: tuple(r)[1:] for r in df.collect()}
    bodies = {i: (t := f"document {i} \u00e9").encode() * (70000 // len(t) + 1) for i in range(2400)}
    assert found == {i: (len(b) + 54, len(b), hashlib.sha256(b).hexdigest()) for i, b in bodies.items()}
    assert sum(map(len, bodies.values())) / read_batches(df._jdf.queryExecution().executedPlan()) < 15e6
