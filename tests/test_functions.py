import pytest
from frames import eth, in_order, ipv4, ipv6, packets, tcp, udp
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netlens.functions import (
    ethernet_pad,
    ethernet_pad_hex,
    geo_fields,
    hex_stream,
    hex_to_bytes,
    is_json_object,
    printable,
    protocol_text,
    trusted_issuer,
)
from netlens.operators.views import readable_payload

SLOW = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def column(spark, values, kind):
    rows = list(enumerate(values))
    return spark.createDataFrame(rows, f"packet_id long, x {kind}")


def show(values: bytes) -> str:
    return "".join(chr(b) if 32 <= b <= 126 else f"\\x{b:02X}" for b in values)


def test_hex_stream(spark):
    df = column(spark, [b"", b"\x00", b"\xff\x0a\xb0", None], "binary")
    assert in_order(df.withColumn("y", hex_stream(F.col("x"))), "y") == [
        ("",), ("00",), ("ff 0a b0",), (None,),
    ]


def test_hex_to_bytes(spark):
    df = column(spark, ["", "0aFF", " 0 a\t\nf f ", "zz", None], "string")
    got = in_order(df.withColumn("y", hex_to_bytes(F.col("x"))), "y")
    assert [None if r[0] is None else bytes(r[0]) for r in got] == [
        b"", b"\x0a\xff", b"\x0a\xff", None, None,
    ]
    odd = column(spark, ["abc"], "string")
    assert in_order(odd.withColumn("y", hex_to_bytes(F.col("x"), strict=False)), "y") == [(None,)]
    with pytest.raises(Exception, match="Invalid hex string"):
        odd.select(hex_to_bytes(F.col("x"))).collect()


def test_printable_every_byte(spark):
    values = [b"", bytes(range(256)), b"\\x41", b"a\r\nb", "é – 漢".encode(), b"\xff" * 3]
    df = column(spark, values, "binary").withColumn("y", printable(F.col("x")))
    assert [r[0] for r in in_order(df, "y")] == [show(v) for v in values]


@SLOW
@given(values=st.lists(st.binary(max_size=300), min_size=1, max_size=40))
def test_random_bytes(spark, values):
    df = column(spark, values, "binary").withColumns(
        {"p": printable(F.col("x")), "back": hex_to_bytes(hex_stream(F.col("x")))}
    )
    assert [(p, bytes(b)) for p, b in in_order(df, "p", "back")] == [(show(v), v) for v in values]


def test_ethernet_pad(spark):
    sizes = [0, 14, 53, 54, 55, 58, 59, 60, 61, 62, 63, 64, 65, 100, 1500]
    frames = [bytes(i % 256 for i in range(n)) for n in sizes]
    df = packets(spark, frames).withColumns(
        {"pad": ethernet_pad(F.col("raw")), "text": ethernet_pad_hex(F.col("raw"))}
    )

    def expected(frame: bytes) -> bytes:
        want = max(64 - len(frame), 0)
        return b"" if 54 + want > len(frame) else frame[54 : 54 + want]

    got = in_order(df, "pad", "text")
    assert [(bytes(p), t) for p, t in got] == [(expected(f), expected(f).hex(" ")) for f in frames]


def test_payload_text(spark):
    frames = [
        eth(0x0800, ipv4(6, tcp(payload=b"GET / HTTP/1.1\r\n"))),
        eth(0x0800, ipv4(6, tcp(payload=b"get / http/1.1\r\n"))),
        eth(0x0800, ipv4(6, tcp(payload=b"HTTP \xff\xfe \xe2\x82 \xc3\xa9"))),
        eth(0x0800, ipv4(6, tcp())),
        eth(0x0800, ipv4(17, udp(payload=b"HTTP"))),
        eth(0x86DD, ipv6(6, tcp(payload=b"HTTP"))),
    ]
    got = [r[0] for r in in_order(readable_payload(packets(spark, frames)), "payload_text")]
    assert got[0] == "GET / HTTP/1.1\r\n"
    assert got[1] == "get / http/1.1\\x0D\\x0A"
    assert got[2] == b"HTTP \xff\xfe \xe2\x82 \xc3\xa9".decode("utf-8", "replace")
    assert got[3] == ""
    assert got[4:] == [show(f) for f in frames[4:]]


def test_protocol_text(spark):
    df = column(spark, [6, 17, 1, 58, 47, 253, None], "int")
    assert [r[0] for r in in_order(df.withColumn("y", protocol_text(F.col("x"))), "y")] == [
        "TCP", "UDP", "ICMP", "IPv6-ICMP", "GRE", "Protocol 253", None,
    ]


def test_geo_fields(spark):
    values = ['{"country":"X","lat":1.5,"extra":1}', "{}", "{broken", "[1]", "text", "", None]
    df = column(spark, values, "string").withColumns(
        {"ok": is_json_object(F.col("x")), "geo": geo_fields(F.col("x"))}
    )
    got = in_order(df, "ok", "geo")
    assert [r[0] for r in got] == [True, True, False, False, False, False, False]
    assert got[0][1].country == "X" and got[0][1].lat == 1.5 and got[0][1].city is None
    assert [r[1] is None for r in got] == [False, False, True, True, True, True, True]


def test_trusted_issuer(spark):
    df = column(spark, ["TrustedCA1", "TrustedCA3", "trustedca1", "TrustedCA4", None], "string")
    got = in_order(df.withColumn("y", trusted_issuer(F.col("x"))), "y")
    assert [r[0] for r in got] == [True, True, False, False, False]
