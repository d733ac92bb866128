"""SYN rates and IP to MAC bindings: by hand, at hot keys, and their plans."""

import datetime

from frames import ACK, PSH, SYN, arp, eth, ipv4, ipv6, packets, tcp
from pyspark.sql import functions as F

from netlens.operators import bindings, flood
from netlens.operators.asof import asof_join

START = datetime.datetime(2024, 1, 1)


def at(seconds: float) -> datetime.datetime:
    return START + datetime.timedelta(seconds=seconds)


def timed(spark, frames):
    """Packets with their seconds: ``[(seconds, frame), ...]``."""
    rows = [(i, at(s), "eth0", f) for i, (s, f) in enumerate(frames)]
    return spark.createDataFrame(rows, packets(spark, []).schema)


def syn(src="10.0.0.5", port=1000, dst="192.168.1.9", flags=SYN):
    return eth(0x0800, ipv4(6, tcp(flags, port, 80), src=src, dst=dst))


def test_half_open(spark):
    frames = [
        (0, syn(port=1)), (29.9, syn(port=1, flags=ACK)),  # answered
        (0, syn(port=2)), (30, syn(port=2, flags=ACK | PSH)),  # just in time
        (0, syn(port=3)), (30.1, syn(port=3, flags=ACK)),  # too late
        (0, syn(port=4)),  # never
        (10, syn(port=5, flags=ACK)), (10, syn(port=5)),  # not later
        (29, syn(port=6)), (31, syn(port=6, flags=ACK)),  # over the edge of a bucket
        (0, syn(port=7)), (1, syn(port=7, flags=SYN | ACK)),  # a SYN-ACK completes nothing
        (5, syn(port=8)), (6, syn(port=8)), (7, syn(port=8, flags=ACK)), (8, syn(port=8)),  # one flow, used again
        (5, syn(port=9)), (6, eth(0x0800, ipv4(6, tcp(ACK, 80, 9), src="192.168.1.9", dst="10.0.0.5"))),  # the other way
        (3, eth(0x86DD, ipv6(6, tcp(SYN, 11, 80)))),
    ]
    got = flood.half_open(timed(spark, frames))
    assert sorted((r["src_port"], r["ts"]) for r in got.collect()) == [
        (3, at(0)), (4, at(0)), (5, at(10)), (7, at(0)), (8, at(8)), (9, at(5)), (11, at(3)),
    ]


def test_rates_in_sliding_windows(spark):
    frames = [(s, syn(src=f"10.0.0.{s % 3}", port=s)) for s in range(1, 13)] + [(3, syn(dst="192.168.1.7"))]
    rows = flood.syn_rates(timed(spark, frames), "10 seconds", "5 seconds", least=3).orderBy("window_start").collect()
    assert [(r["window_start"], r["dst_ip"], r["n_half_open"], r["n_sources"]) for r in rows] == [
        (at(-5), "192.168.1.9", 4, 3),
        (at(0), "192.168.1.9", 9, 3),
        (at(5), "192.168.1.9", 8, 3),
        (at(10), "192.168.1.9", 3, 3),
    ]


def test_a_hot_target_is_counted_by_many_tasks(spark):
    opened = spark.range(60_000).select(
        F.lit(START).cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("10.0.0."), (F.col("id") % 250).cast("string")).alias("src_ip"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("dst_ip"),
    )
    out = flood.rates(opened, "10 seconds", "5 seconds", least=1_000)
    assert {(r["dst_ip"], r["n_half_open"], r["n_sources"]) for r in out.collect()} == {("hot", 20_000, 250)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "src_ip" in plan.split("Exchange hashpartitioning")[-1].split("\n")[0] and "Python" not in plan


def claim(ip, mac, frame_mac=None):
    return eth(0x0806, arp(ip, mac))


A, B, C = "02:00:00:00:00:0a", "02:00:00:00:00:0b", "02:00:00:00:00:0c"


def test_history_of_bindings(spark):
    frames = [
        (0, claim("10.0.0.1", A)), (10, claim("10.0.0.1", A)), (3_599, claim("10.0.0.1", A)),
        (3_700, claim("10.0.0.1", A)),  # the same in the next bucket
        (7_300, claim("10.0.0.1", B)), (7_301, claim("10.0.0.1", A)), (7_302, claim("10.0.0.1", A)),
        (5, claim("10.0.0.2", C)), (6, claim("0.0.0.0", C)), (20, syn()),
    ]
    rows = bindings.mac_history(timed(spark, frames)).orderBy("ip", "valid_from").collect()
    assert [tuple(r) for r in rows] == [
        ("10.0.0.1", A, None, at(0), at(7_300)),
        ("10.0.0.1", B, A, at(7_300), at(7_301)),
        ("10.0.0.1", A, B, at(7_301), None),
        ("10.0.0.2", C, None, at(5), None),
    ]
    assert bindings.mac_history(timed(spark, [])).count() == 0


def test_binding_in_force(spark):
    frames = [
        (1, syn(src="10.0.0.1")), (2, claim("10.0.0.1", A)), (2, syn(src="10.0.0.1")), (9_000, syn(src="10.0.0.1")),
        (9_001, claim("10.0.0.1", "02:00:00:00:00:01")), (9_002, syn(src="10.0.0.1")), (50_000, syn(src="10.0.0.3")),
        (60_000, eth(0x0026, b"BB\x03" + bytes(40))), (60_001, claim("10.0.0.1", A)),
    ]
    got = bindings.mac_in_force(timed(spark, frames)).orderBy("packet_id").collect()
    assert [(r["bound_mac"], r["mac_differs"]) for r in got] == [
        (None, False), (A, True), (A, True), (A, True), ("02:00:00:00:00:01", False), ("02:00:00:00:00:01", False), (None, False), (None, False), (A, True),
    ]
    assert len(got) == len(frames)


def test_asof_join_against_plain_python(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), at(rng.randrange(400)), i, f"r{i}") for i in range(600)]
    values = [(rng.choice(["hot", "a", "c", None]), at(rng.randrange(400)), i, f"v{i}") for i in range(120)]
    left = spark.createDataFrame(rows, "k string, t timestamp_ntz, s long, name string")
    right = spark.createDataFrame(values, "k string, t timestamp_ntz, s long, v string")
    for width in (7, 100, 10_000):
        got = asof_join(left, right, "k", "t", "s", ["v"], width).select("name", "v").collect()
        want = []
        for k, t, s, name in rows:
            before = [(vt, vs, v) for vk, vt, vs, v in values if vk == k and k is not None and (vt, vs) <= (t, s)]
            want.append((name, max(before)[2] if before else None))
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_asof_join_has_no_range_join(spark):
    left = spark.createDataFrame([], "k string, t timestamp_ntz, s long")
    right = spark.createDataFrame([], "k string, t timestamp_ntz, s long, v string")
    plan = asof_join(left, right, "k", "t", "s", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
