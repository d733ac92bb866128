import json

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from netlens.functions.addresses import ip_argument, normal_ip
from netlens.operators.enrich import Lookups, enrich_both_ends, enrich_ip, ip_info
from netlens.operators.filters import host_filter, host_set_filter
from netlens.operators.keyed import append_status, insert_if_absent
from netlens.operators.lookup import exists_flag, lookup_join
from netlens.operators.views import log_records
from netlens.plans.fixture import lookups, packets_raw


@pytest.mark.parametrize("strategy", [None, "merge", "broadcast"])
def test_join_with_heavy_keys_equals_plain_join(spark, strategy):
    """5,000 heavy keys, rows without a key, keys that the lookup lacks."""
    left = spark.range(200_000).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("hot"), F.col("id") % 5_000)).when(F.col("id") % 7 == 0, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 90_000)).alias("k"),
    )
    right = spark.sql("select concat('hot', id) as key, id as v from range(5000) union all select concat('k', id), -id from range(30000)")
    plain = left.join(right, left["k"] == right["key"], "left").drop("key")
    got = lookup_join(left, right, "k", "key", "id", strategy=strategy)
    assert got.columns == ["id", "k", "v"]
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()


def test_rows_without_a_key_are_spread(spark):
    left = spark.range(40_000).select("id", F.lit(None).cast("string").alias("k"))
    right = spark.sql("select concat('k', id) as key, id as v from range(100)")
    got = lookup_join(left, right, "k", "key", "id", strategy="merge").withColumn("p", F.spark_partition_id())
    parts = [r["count"] for r in got.groupBy("p").count().collect()]
    assert sum(parts) == 40_000 and max(parts) < 3 * min(parts)


def test_flag_is_never_null(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id long, k string")
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    got = exists_flag(left, keys, "k", "k", "there", "id").orderBy("id")
    assert [r["there"] for r in got.collect()] == [True, False, False]


GEO = json.dumps({"country": "Testland", "city": "T", "lat": 1.5, "lon": -2.0})


def small_lookups(spark):
    ptr = spark.createDataFrame([("1.1.1.1", "one.example")], "ip string, domain string")
    whois = spark.createDataFrame([("1.1.1.1", "a\nb\n"), ("2.2.2.2", "c\n")], "ip string, whois string")
    geo = spark.createDataFrame(
        [("1.1.1.1", GEO), ("1.1.1.1", GEO), ("2.2.2.2", "{broken"), ("Testville", GEO), ("2001:DB8::7", GEO)],
        "ip string, geo_json string",
    )
    return Lookups(ptr, whois, geo)


@pytest.mark.parametrize("options", [{}, {"strategy": "merge"}])
def test_enrich_ip(spark, options):
    rows = [(0, "1.1.1.1"), (1, "2.2.2.2"), (2, "3.3.3.3"), (3, None), (4, "Testville"), (5, "1.1.1.1"), (6, "2001:db8:0:0:0:0:0:7")]
    df = spark.createDataFrame(rows, "packet_id long, ip_col string")
    rich = enrich_ip(df, "ip_col", small_lookups(spark), **options)
    got = {
        r["packet_id"]: (r["domainName"], r["whoisData"], r["geoData"] and r["geoData"]["country"], r["status"])
        for r in rich.collect()
    }
    assert got == {
        0: ("one.example", "a\nb\n", "Testland", "ok"),
        1: (None, "c\n", None, "error"),
        2: (None, None, None, "error"),
        3: (None, None, None, None),
        4: (None, None, "Testland", "ok"),
        5: ("one.example", "a\nb\n", "Testland", "ok"),
        6: (None, None, "Testland", "ok"),
    }
    kept = enrich_ip(df, "ip_col", small_lookups(spark), drop_errors=True, **options)
    assert sorted(r["packet_id"] for r in kept.collect()) == [0, 4, 5, 6]


def test_ip_info_is_one_row_per_address(spark):
    ips = spark.createDataFrame([("1.1.1.1",), ("1.1.1.1",), (None,), ("9.9.9.9",)], "ip string")
    info = {r["ip"]: r["domainName"] for r in ip_info(ips, small_lookups(spark)).collect()}
    assert info == {"1.1.1.1": "one.example", "9.9.9.9": None}


def test_both_ends_shuffled_equals_broadcast(spark):
    rows = log_records(packets_raw(spark, SF_DIR), "base", keep=["packet_id"])
    tables = lookups(spark, SF_DIR)
    # Make the destination end answer as well.
    extra = tables.ptr.unionByName(
        spark.sql("select concat('192.168.1.', id) as ip, concat('lan-', id) as domain from range(1, 100)")
    )
    tables = Lookups(extra, tables.whois, tables.geo)
    small = enrich_both_ends(rows, tables, spread_by="packet_id")
    large = enrich_both_ends(rows, tables, spread_by="packet_id", strategy="merge").select(small.columns)
    assert small.count() == rows.count() == 3642
    assert small.exceptAll(large).isEmpty() and large.exceptAll(small).isEmpty()
    assert small.filter("dst_domainName like 'lan-%'").count() > 0


ADDRESSES = {
    "10.0.1.2": "10.0.1.2",
    " 10.0.1.2 ": "10.0.1.2",
    "2001:db8::4": "2001:db8:0:0:0:0:0:4",
    "2001:0DB8:0000:0:0::0004": "2001:db8:0:0:0:0:0:4",
    "::": "0:0:0:0:0:0:0:0",
    "::1": "0:0:0:0:0:0:0:1",
    "fe80::": "fe80:0:0:0:0:0:0:0",
    "::ffff:192.168.0.10": "0:0:0:0:0:ffff:c0a8:a",
    "1:2:3:4:5:6:7:8": "1:2:3:4:5:6:7:8",
    "1:2:3:4:5:6:1.2.3.4": "1:2:3:4:5:6:102:304",
}


def test_one_spelling_of_addresses(spark):
    assert {a: ip_argument(a) for a in ADDRESSES} == ADDRESSES
    df = spark.createDataFrame([(a,) for a in [*ADDRESSES, "Testville", None]], "ip string")
    got = {r["ip"]: r["n"] for r in df.withColumn("n", normal_ip(F.col("ip"))).collect()}
    assert got == ADDRESSES | {"Testville": "Testville", None: None}
    with pytest.raises(ValueError):
        host_filter(packets_raw(spark, SF_DIR), "2001:db8:::4")


def test_hosts_in_any_spelling(spark):
    frames = packets_raw(spark, SF_DIR)
    hosts = spark.createDataFrame([("2001:DB8::4",), ("10.0.1.2",)], "ip string")
    one = {r["packet_id"] for r in host_filter(frames, "2001:db8::4").collect()}
    two = {r["packet_id"] for r in host_filter(frames, "10.0.1.2").collect()}
    assert one and {r["packet_id"] for r in host_set_filter(frames, hosts).collect()} == one | two


def test_insert_if_absent(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "key string, seq long")
    rows = [("c", 11), ("c", 10), ("a", 12), (None, 13), (None, 14), ("d", 15)]
    batch = spark.createDataFrame(rows, "key string, seq long")
    kept, refused = insert_if_absent(target, batch, "key", "seq")
    added = {(r["key"], r["seq"]) for r in kept.exceptAll(target).collect()}
    assert added == {("c", 10), (None, 13), (None, 14), ("d", 15)}
    assert {(r["key"], r["seq"]) for r in refused.collect()} == {("c", 11), ("a", 12)}
    assert append_status(target, batch, "key", "seq").count() == len(rows)
