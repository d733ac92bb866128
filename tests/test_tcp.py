"""TCP streams and the certificates in them, from hand-made segments."""

import datetime
import random
import struct

import pytest
from conftest import SF_DIR
from frames import ACK, SYN, eth, ipv4, ipv6, packets, tcp
from pyspark.sql import functions as F

from netlens.functions import tls
from netlens.operators import rules
from netlens.operators.certificates import judged_certificates, with_certificates
from netlens.operators.decode import tcp_segments
from netlens.operators.tcp import CHUNK, heads, pieces, streams
from netlens.plans import fixture

START = datetime.datetime(2024, 1, 1)


def segment(seq, payload=b"", flags=ACK, src=443, dst=1024, v6=False):
    body = bytearray(tcp(flags, src, dst, payload))
    body[4:8] = struct.pack(">I", seq % (1 << 32))
    return eth(0x86DD, ipv6(6, bytes(body))) if v6 else eth(0x0800, ipv4(6, bytes(body)))


def timed(spark, frames):
    rows = [(i, START + datetime.timedelta(seconds=s), "eth0", f) for i, (s, f) in enumerate(frames)]
    return spark.createDataFrame(rows, packets(spark, []).schema).repartition(3)


def joined(df):
    """(src_port, connection) -> [(offset, bytes), ...] with stretches that meet put together."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["src_port"], r["connection"], r["offset"])):
        found = out.setdefault((r["src_port"], r["connection"]), [])
        if found and found[-1][0] + len(found[-1][1]) == r["offset"]:
            found[-1] = (found[-1][0], found[-1][1] + bytes(r["data"]))
        else:
            found.append((r["offset"], bytes(r["data"])))
    return out


CASES = {
    "in order": ([(0, segment(9, flags=SYN)), (1, segment(10, b"abc")), (2, segment(13, b"def"))], {(443, 1): [(0, b"abcdef")]}),
    "out of order": ([(0, segment(9, flags=SYN)), (1, segment(13, b"def")), (2, segment(10, b"abc"))], {(443, 1): [(0, b"abcdef")]}),
    "first bytes stay": ([(0, segment(9, flags=SYN)), (1, segment(12, b"cde")), (2, segment(10, b"XYZXYZX"))], {(443, 1): [(0, b"XYcdeZX")]}),
    "gap": ([(0, segment(9, flags=SYN)), (1, segment(10, b"ab")), (2, segment(15, b"f"))], {(443, 1): [(0, b"ab"), (5, b"f")]}),
    "wrap": ([(0, segment(2**32 - 3, flags=SYN)), (1, segment(2**32 - 2, b"abcd")), (2, segment(2, b"ef"))], {(443, 1): [(0, b"abcdef")]}),
    "no syn": ([(0, segment(2**32 - 1, b"bc")), (1, segment(2**32 - 2, b"a")), (2, segment(1, b"d"))], {(443, 0): [(0, b"abcd")]}),
    "syn again": ([(0, segment(9, flags=SYN)), (1, segment(9, flags=SYN)), (2, segment(10, b"a"))], {(443, 1): [(0, b"a")]}),
    "data with syn": ([(0, segment(9, b"ab", SYN)), (1, segment(12, b"c"))], {(443, 1): [(0, b"abc")]}),
    "keep-alive": ([(0, segment(9, flags=SYN)), (1, segment(9, b"\0")), (2, segment(10, b"ab"))], {(443, 1): [(0, b"ab")]}),
    "port used again": (
        [(0, segment(9, flags=SYN)), (1, segment(10, b"one")), (700, segment(3_000_000_000, flags=SYN)), (701, segment(3_000_000_001, b"two")),
         (702, segment(5, flags=SYN)), (703, segment(6, b"three")), (9_000, segment(11, b"!"))],
        {(443, 1): [(0, b"one")], (443, 2): [(0, b"two")], (443, 3): [(0, b"three!")]},
    ),
    "syn after a bucket": ([(0, segment(4, b"old")), (599, segment(9, flags=SYN)), (601, segment(10, b"a")), (1_300, segment(9, flags=SYN)), (1_301, segment(11, b"b"))],
                           {(443, 0): [(0, b"old")], (443, 1): [(0, b"ab")]}),
    "both ways": ([(0, segment(5, b"q", src=1024, dst=443)), (1, segment(7, b"r"))], {(443, 0): [(0, b"r")], (1024, 0): [(0, b"q")]}),
    "ipv6": ([(0, segment(5, b"six", v6=True))], {(443, 0): [(0, b"six")]}),
    "nothing": ([(0, segment(5)), (1, eth(0x0806, b"x" * 28))], {}),
}


@pytest.mark.parametrize("name", CASES)
def test_streams(spark, name):
    frames, want = CASES[name]
    assert joined(streams(timed(spark, frames))) == want


def test_a_hot_flow_against_its_bytes(spark):
    """One flow of a third of all packets: over 2^32, over many buckets of time, shuffled and repeated."""
    rng = random.Random(6)
    data = rng.randbytes(300_000)
    first = 2**32 - 120_000
    frames, at, seconds = [(0, segment(first - 1, flags=SYN))], 0, 1.0
    while at < len(data):
        size = rng.randrange(1, 700)
        frames.append((seconds + rng.random() * 0.5, segment(first + at, data[at : at + size])))
        if rng.random() < 0.2:
            back = max(0, at - rng.randrange(900))
            frames.append((seconds + 2 + rng.random(), segment(first + back, data[back : at + size])))
        at += size
        seconds += rng.random() * 20
    others = [(rng.random() * seconds, segment(7, bytes([i % 256]) * 5, src=443, dst=2_000 + i)) for i in range(2 * len(frames))]
    df = timed(spark, frames + others)
    found = streams(df)
    hot = joined(found.where("dst_port = 1024"))
    assert hot == {(443, 1): [(0, data)]}
    assert found.where("dst_port >= 2000 and length(data) = 5 and offset = 0").count() == len(others)
    assert found.agg(F.max(F.length("data"))).first()[0] == CHUNK
    head = heads(df, 100_000).where("dst_port = 1024").first()
    assert bytes(head["head"]) == data[:100_000]


def test_heads_are_the_beginnings_of_streams(spark):
    """Over several chunks, with repeats, gaps, lost beginnings and ports used again."""
    rng = random.Random(8)
    frames = []
    for port in range(1_000, 1_012):
        data, first, at, lost = rng.randbytes(rng.randrange(1, 200_000)), rng.randrange(1 << 32), 0, rng.choice([0, 0, 0, 1])
        if port % 3:
            frames.append((rng.random(), segment(first - 1, flags=SYN, dst=port)))
        while at < len(data):
            size = rng.randrange(1, 9_000)
            if not lost and rng.random() > 0.01:
                for _ in range(rng.choice([1, 1, 2])):
                    frames.append((1 + at / 50 + rng.random() * 300, segment(first + at, data[at : at + size], dst=port)))
            at, lost = at + size, 0
        frames += [(9_000, segment(first - 5, flags=SYN, dst=port)), (9_001, segment(first - 4, b"again", dst=port))]
    df = timed(spark, frames)
    for limit in (100, CHUNK, 100_000, 4 * CHUNK):
        want = {}
        for r in sorted(streams(df, limit).collect(), key=lambda r: (r["dst_port"], r["connection"], r["offset"])):
            head, seen = want.get((r["dst_port"], r["connection"]), (b"", r["seen"]))
            head += bytes(r["data"]) if len(head) == r["offset"] else b""
            want[r["dst_port"], r["connection"]] = head, min(seen, r["seen"])
        got = {(r["dst_port"], r["connection"]): (bytes(r["head"]), r["seen"]) for r in heads(df, limit).collect()}
        assert got == want and len(want) >= 12
    assert any(not head for head, _ in got.values()) and any(len(head) > CHUNK for head, _ in got.values())


def test_stored_segments_are_read_three_times(spark):
    """For what buckets hand on, for where connections begin, and for the payloads, which come last."""
    found = streams(timed(spark, [(0, segment(5, b"x"))]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.split("\n") if "Relation [" in line]
    assert len(scans) == 3
    assert plan.count("Window ") == 2


def test_packets_are_decoded_and_sorted_once(spark):
    """What follows the stored segments has windows over buckets only, one row each."""
    plan = streams(timed(spark, [(0, segment(5, b"x"))]))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "+- Window " in line]
    assert windows and all("_jump" in w or "last_seq" in w for w in windows)
    assert "substring" not in plan.split("Join")[-1] and "conv(" not in plan


# Certificates ---------------------------------------------------------------------


def der(tag, *content):
    body = b"".join(content)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2)
    return bytes([tag]) + size + body


def name(cn, tag=0x0C, encode="utf-8"):
    return der(0x30, der(0x31, der(0x30, der(6, b"\x55\x04\x0a"), der(0x0C, b"Ex"))), der(0x31, der(0x30, der(6, b"\x55\x04\x03"), der(tag, cn.encode(encode)))))


def cert(issuer="TrustedCA1", subject="site.example", begin=b"230101000000Z", end=b"20991231235959Z", version=True):
    parts = [der(0xA0, der(2, b"\x02"))] if version else []
    validity = der(0x30, der(0x17, begin), der(0x18 if len(end) > 13 else 0x17, end))
    parts += [der(2, b"\x01\x02"), der(0x30, der(6, b"\x2a")), name(issuer), validity, name(subject), der(3, bytes(300))]
    return der(0x30, der(0x30, *parts), der(0x30, der(6, b"\x2a")), der(3, bytes(200)))


def message(*certs):
    listed = b"".join(len(c).to_bytes(3) + c for c in certs)
    body = len(listed).to_bytes(3) + listed
    return b"\x0b" + len(body).to_bytes(3) + body


def records(data, size=16_000, kind=22):
    return b"".join(bytes([kind, 3, 3]) + len(data[i : i + size]).to_bytes(2) + data[i : i + size] for i in range(0, len(data), size))


HELLO = b"\x02" + (70).to_bytes(3) + bytes(70)


def test_certificates_of_a_handshake():
    stream = records(HELLO + message(cert(), cert("Root", "TrustedCA1")), 333) + records(b"\x01" * 20, kind=23)
    found = [tls.certificate(d) for d in tls.certificate_list(stream)]
    assert [c["subject"] for c in found] == ["O=Ex, CN=site.example", "O=Ex, CN=TrustedCA1"]
    assert (found[0]["issuer_cn"], found[0]["not_before"], found[0]["not_after"], found[0]["serial"]) == ("TrustedCA1", "2023-01-01 00:00:00", "2099-12-31 23:59:59", "0102")
    assert tls.certificate(cert(version=False))["subject"] == "O=Ex, CN=site.example"
    assert tls.certificate(cert(begin=b"500101000000Z"))["not_before"].startswith("1950")
    assert tls._name(next(tls.elements(name("héß", 0x1E, "utf-16-be")))[1])[1] == "héß"


def test_damaged_handshakes_give_no_certificate_and_no_error():
    stream = records(HELLO + message(cert()), 200)
    whole = tls.certificate_list(stream)
    assert len(whole) == 1
    for n in range(len(stream)):
        assert tls.certificate_list(stream[:n]) in ([], whole)
    rng = random.Random(1)
    for _ in range(3_000):
        bad = bytearray(stream)
        for _ in range(rng.randrange(1, 6)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        for c in tls.certificate_list(bytes(bad)):
            tls.certificate(c)
        tls.certificate(rng.randbytes(rng.randrange(60)))


def asked(port):
    """A packet of the client."""
    body = tcp(ACK, port, 443, b"hello")
    return eth(0x0800, ipv4(6, body, src="192.168.1.9", dst="10.0.0.5"))


def test_the_rule_fires_on_a_handshake_in_pieces(spark):
    """Cut over three segments, out of order, one repeated; by each reason; and not on a good one."""
    kinds = [
        (cert("Unknown"), ["issuer"]), (cert(), []), (cert(end=b"231231235959Z"), ["expired"]), (cert(begin=b"250101000000Z"), ["not_yet_valid"]),
        (cert("site.example"), ["issuer", "self_signed"]),
    ]
    frames, want = [], {}
    for i, (c, reasons) in enumerate(kinds):
        stream, port, seq = records(HELLO + message(c), 300), 5_000 + i, 2**32 - 100
        third = len(stream) // 3
        parts = [stream[:third], stream[third : 2 * third], stream[2 * third :]]
        frames += [(i, asked(port)), (i, segment(seq - 1, flags=SYN | ACK, dst=port))]
        for k in (2, 0, 1, 0):
            frames.append((i + 0.1, segment(seq + k * third, parts[k], dst=port)))
        want[port] = reasons
    frames += [(9, segment(5, records(HELLO + message(cert("Unknown"))), src=80, dst=6_000)), (9, eth(0x0806, bytes(28)))]
    df = timed(spark, frames)
    got = {r["dst_port"]: list(r["reasons"]) for r in judged_certificates(df).collect()}
    assert got == want
    own = [("certificate", lambda: F.col("certificate_reasons").isNotNull())]
    hit = rules.anomalies(with_certificates(df), own)
    assert sorted(r["packet_id"] for r in hit.select("packet_id").collect()) == [i for i in range(30) if want[5_000 + i // 6]]
    assert with_certificates(df).count() == len(frames)


def test_flows_are_compared_as_plain_text(spark):
    """Both directions, both kinds of addresses, no JSON for each packet; ports alone make no flow."""
    shown = records(HELLO + message(cert("Unknown")))
    ask = lambda port: tcp(ACK, port, 443, b"q")
    frames = [
        (0, segment(5, shown, dst=700, v6=True)), (1, segment(5, shown, dst=701)),
        (2, asked(701)), (3, asked(700)), (4, eth(0x0800, ipv4(6, ask(701), src="192.168.1.8", dst="10.0.0.5"))), (5, segment(5, dst=700, v6=True)), (6, eth(0x0806, bytes(28))),
    ]
    found = with_certificates(timed(spark, frames))
    assert "json" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r["packet_id"]: r["certificate_reasons"] for r in found.collect()} == {i: ["issuer"] if i in (0, 1, 2, 5) else None for i in range(7)}


def test_heads_are_read_where_they_are_put_together(spark):
    """Pieces are shuffled once more; certificates are read in the task that has the bytes."""
    frames = [(0, segment(5, records(HELLO + message(cert("Unknown")))))]
    plan = judged_certificates(timed(spark, frames))._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    assert "Aggregate" not in above and "Repartition" not in above


def test_times_of_certificates():
    """Usual ones are read without ``strptime``; the others as before."""
    for text, want in (("230102030405Z", "2023-01-02 03:04:05"), ("991231235959Z", "1999-12-31 23:59:59")):
        assert str(tls._time(0x17, text.encode())) == want
    for text in ("20240229000000Z", "00010101000000Z", "2024022900000Z", "20240229000000z"):
        assert tls._time(0x18, text.encode()) == datetime.datetime.strptime(text, "%Y%m%d%H%M%SZ")
    for text in ("20230229000000Z", "20231301000000Z", "00000101000000Z", "20230101240000Z", "20230101000060Z", "20230101000061Z", "20230101000000", "2023010100000000Z"):
        with pytest.raises(ValueError):
            tls._time(0x18, text.encode())


def test_content_of_nested_elements_is_computed_once(spark):
    """And not once for each use of its length."""
    body = fixture._tlv("31", fixture._tlv("30", fixture._tlv("0C", F.upper("name").cast("binary"))))
    found = spark.createDataFrame([("ab",), ("x" * 200,), (None,)], "name string").select(body.alias("der"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1
    inner = der(0x0C, b"AB")
    assert [r["der"] if r["der"] is None else bytes(r["der"]) for r in found.collect()] == [
        der(0x31, der(0x30, inner)), b"\x31\x82\x00\xd0\x30\x82\x00\xcc\x0c\x82\x00\xc8" + b"X" * 200, None,
    ]


def test_payloads_are_joined_once(spark):
    """The last join has the payloads, and the stored rows go straight into it."""
    found = pieces(tcp_segments(fixture.document_streams(spark, SF_DIR)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    last = next(line for line in plan.split("\n") if "Join Inner" in line)
    assert "_opened" in last and "_syn_seen" in last


def test_frames_are_built_after_they_are_dealt_out(spark):
    """The source rows go through the shuffle, not the larger frames."""
    for build in (fixture.build_long_frames, fixture.build_document_streams, fixture.build_handshakes, fixture.build_frames):
        plan = build(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Repartition") > plan.index("AS raw")
