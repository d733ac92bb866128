"""Sessions of flows against a walk packet by packet."""

import datetime
import random

import pytest
from frames import ACK, FIN, RST, SYN, eth, ipv4, ipv6, packets, tcp, udp

from netlens.operators.sessions import flow_packets, numbered, sessions

START = datetime.datetime(2024, 1, 1)


def walked(rows, idle):
    """{packet_id: session} by walking each flow; rows of (packet_id, seconds, flow, opens, closes)."""
    out, state = {}, {}
    for packet_id, seconds, flow, opens, closes in sorted(rows, key=lambda r: (r[1], r[0])):
        number, last, closed, at_syn = state.get(flow, (0, None, 0, 0))
        if last is None or seconds - last > idle or (opens and closed > at_syn):
            number += 1
        at_syn = closed if opens else at_syn
        state[flow] = (number, seconds, closed + closes, at_syn)
        out[packet_id] = number
    return out


@pytest.mark.parametrize(("width", "seed"), [(1, 1), (20, 2), (300, 3), (10_000, 4)])
def test_sessions_against_a_walk(spark, width, seed):
    rng = random.Random(seed)
    frames, want, seconds = [], [], 0.0
    for i in range(1_500):
        seconds += rng.choice([0, 0.5, 1, 5, 29, 30, 31, 200]) if rng.random() < 0.4 else 0.25
        port = 1000 if rng.random() < 0.4 else 1001 + rng.randrange(4)
        flags = rng.choice([SYN, ACK, ACK, ACK, FIN | ACK, RST, SYN | ACK])
        is_udp = rng.random() < 0.1
        there = rng.random() < 0.5
        body = udp(port, 53) if is_udp else tcp(flags, port, 53)
        back = udp(53, port) if is_udp else tcp(flags, 53, port)
        frames.append((i, START + datetime.timedelta(seconds=seconds), "eth0", eth(0x0800, ipv4(17 if is_udp else 6, body, src="10.0.0.5", dst="10.0.0.9") if there else ipv4(17 if is_udp else 6, back, src="10.0.0.9", dst="10.0.0.5"))))
        want.append((i, seconds, (is_udp, port), not is_udp and flags == SYN, not is_udp and bool(flags & (FIN | RST))))
    df = spark.createDataFrame(frames, packets(spark, []).schema).repartition(3)
    got = numbered(flow_packets(df), idle=30, width=width)
    assert {r["packet_id"]: r["session"] for r in got.select("packet_id", "session").collect()} == walked(want, 30)


def test_a_session_by_hand(spark):
    there = lambda flags: eth(0x86DD, ipv6(6, tcp(flags, 5000, 80), src="2001:db8::1", dst="2001:db8::2"))
    back = lambda flags: eth(0x86DD, ipv6(6, tcp(flags, 80, 5000), src="2001:db8::2", dst="2001:db8::1"))
    sent = [(0, there(SYN)), (1, back(SYN | ACK)), (2, there(ACK)), (3, there(FIN | ACK)), (4, back(FIN | ACK)), (5, there(ACK)), (6, there(SYN)), (7, there(RST)),
            (2, eth(0x0806, bytes(28))), (500, there(ACK))]
    df = spark.createDataFrame([(i, START + datetime.timedelta(seconds=s), "eth0", f) for i, (s, f) in enumerate(sent)], packets(spark, []).schema)
    rows = sessions(df).orderBy("session").collect()
    assert [(r["session"], r["n_packets"], r["n_from_low"], r["opened"], r["closed"]) for r in rows] == [(1, 6, 4, True, True), (2, 2, 2, True, True), (3, 1, 1, False, False)]
    assert rows[0]["first_ts"] == START and rows[0]["last_ts"] == START + datetime.timedelta(seconds=5)
    assert rows[0]["n_bytes"] == sum(len(f) for _, f in sent[:6]) and rows[0]["low_port"] == 5000
    assert sessions(df.limit(0)).count() == 0


def test_windows_over_packets_are_parted_by_bucket(spark):
    plan = sessions(spark.createDataFrame([], packets(spark, []).schema))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "+- Window " in line]
    assert windows and all("packet_id" not in w for w in windows)
