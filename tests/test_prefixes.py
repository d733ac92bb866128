"""Longest prefixes and ranges against Python's ipaddress."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from netlens.operators.prefixes import longest_prefix, match_prefixes, networks, ranges_to_prefixes


def table(spark, rows):
    return spark.createDataFrame(rows, "prefix string, label string")


def test_longest_prefix_against_ipaddress(spark):
    rng = random.Random(3)
    nets = [(f"{ipaddress.ip_network((rng.getrandbits(32) >> s << s, 32 - s))}", f"n{i}") for i, s in enumerate(rng.choices([0, 4, 8, 12, 16, 24, 31, 32], k=60))]
    nets += [(f"{ipaddress.ip_network((rng.getrandbits(128) >> s << s, 128 - s))}", f"s{i}") for i, s in enumerate(rng.choices([0, 1, 64, 96, 127, 128], k=40))]
    known = [ipaddress.ip_network(p) for p, _ in nets]
    ips = [str(n[rng.randrange(min(n.num_addresses, 1 << 40))]) for n in known] + [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(50)]
    got = {r["ip"]: r["label"] for r in longest_prefix(spark.createDataFrame([(i,) for i in ips], "ip string"), table(spark, nets), ["label"]).collect()}
    for ip in ips:
        address = ipaddress.ip_address(ip)
        fits = [(n.prefixlen, label) for n, (_, label) in zip(known, nets) if address.version == n.version and address in n]
        normal = ip if address.version == 4 else ":".join(f"{int(g, 16):x}" for g in address.exploded.split(":"))
        best = max((n for n, _ in fits), default=None)
        assert got.get(normal) == min((label for n, label in fits if n == best), default=None)


def test_odd_prefixes_and_addresses(spark):
    rows = [
        ("10.1.2.3", "host"), (" 10.0.0.0/8 ", "ten"), ("10.9.9.9/16", "unmasked"), ("10.0.0.0/33", "bad"), ("10.0.0/8", "bad"), ("x/8", "bad"),
        ("10.0.0.0/8/8", "bad"), ("::/0", "six"), ("::ffff:0:0/97", "more"), (None, "null"), ("300.0.0.0/8", "bad"), ("10.0.0.0/", "bad"),
    ]
    assert {r["label"] for r in networks(table(spark, rows)).collect()} == {"host", "ten", "unmasked", "six", "more"}
    df = spark.createDataFrame([(1, "10.1.2.3"), (2, "10.9.1.1"), (3, "11.0.0.1"), (4, None), (5, "no address"), (6, "0:0:0:0:0:0:0:1")], "packet_id long, ip string")
    got = match_prefixes(df, "ip", table(spark, rows), ["label"])
    assert [r["label"] for r in got.orderBy("packet_id").collect()] == ["host", "unmasked", None, None, None, "six"]
    assert match_prefixes(df, "ip", table(spark, []), ["label"]).where("label is null").count() == 6


@pytest.mark.parametrize(("first", "last"), [("0.0.0.0", "255.255.255.255"), ("10.0.0.1", "10.0.0.1"), ("10.0.0.0", "10.0.3.255"), ("10.0.0.1", "10.0.0.254"), ("0.0.0.1", "255.255.255.254"), ("9.255.255.255", "10.0.0.0")])
def test_ranges(spark, first, last):
    df = spark.createDataFrame([(first, last, "x")], "first string, last string, label string")
    got = sorted(ipaddress.ip_network(r["prefix"]) for r in ranges_to_prefixes(df).collect())
    want = sorted(ipaddress.summarize_address_range(ipaddress.ip_address(first), ipaddress.ip_address(last)))
    assert got == want


def test_random_and_bad_ranges(spark):
    rng = random.Random(5)
    pairs = [sorted(rng.getrandbits(32) >> rng.randrange(20) for _ in range(2)) for _ in range(150)]
    rows = [(str(ipaddress.ip_address(a)), str(ipaddress.ip_address(b)), str(i)) for i, (a, b) in enumerate(pairs)]
    bad = [("10.0.0.2", "10.0.0.1", "bad"), (None, "10.0.0.1", "bad"), ("x", "10.0.0.1", "bad"), ("::1", "::2", "bad")]
    got = ranges_to_prefixes(spark.createDataFrame(rows + bad, "first string, last string, label string"))
    found = {r["label"]: sorted(map(ipaddress.ip_network, r["p"])) for r in got.groupBy("label").agg(F.collect_list("prefix").alias("p")).collect()}
    assert found == {str(i): sorted(ipaddress.summarize_address_range(*map(ipaddress.ip_address, p))) for i, p in enumerate(pairs)}


def test_no_range_join(spark):
    df = spark.createDataFrame([], "packet_id long, ip string")
    plan = match_prefixes(df, "ip", table(spark, []), ["label"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
