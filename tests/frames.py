"""Hand-made frames."""

from __future__ import annotations

import datetime
import ipaddress
import struct

from netlens.schema import PACKETS_RAW

SRC, DST = "020000000001", "0200000000c8"
SYN, ACK, FIN, PSH, RST, URG = 0x02, 0x10, 0x01, 0x08, 0x04, 0x20


def eth(kind: int, body: bytes, pad_to: int = 0) -> bytes:
    frame = bytes.fromhex(DST + SRC) + struct.pack(">H", kind) + body
    return frame.ljust(pad_to, b"\xa5")


def tcp(flags: int = ACK, src: int = 1024, dst: int = 8080, payload: bytes = b"", options: bytes = b"") -> bytes:
    offset = (20 + len(options)) // 4 << 4
    return struct.pack(">HHIIBBHHH", src, dst, 1, 0, offset, flags, 0xFFFF, 0, 0) + options + payload


def udp(src: int = 1024, dst: int = 8080, payload: bytes = b"") -> bytes:
    return struct.pack(">HHHH", src, dst, 8 + len(payload), 0) + payload


def ipv4(
    proto: int, body: bytes, src="10.0.0.5", dst="192.168.1.9", options: bytes = b"", fragment: int = 0,
    total: int | None = None,
) -> bytes:
    head = 20 + len(options)
    total = head + len(body) if total is None else total
    return (
        struct.pack(">BBHHHBBH", 0x40 | head // 4, 0, total, 0, fragment, 64, proto, 0)
        + ipaddress.ip_address(src).packed
        + ipaddress.ip_address(dst).packed
        + options
        + body
    )


def ipv6(next_header: int, body: bytes, src="2001:db8::1", dst="2001:db8:0:1::2") -> bytes:
    return (
        struct.pack(">IHBB", 0x60000000, len(body), next_header, 64)
        + ipaddress.ip_address(src).packed
        + ipaddress.ip_address(dst).packed
        + body
    )


def arp(ip: str, mac: str, op: int = 1) -> bytes:
    return (
        struct.pack(">HHBBH", 1, 0x0800, 6, 4, op)
        + bytes.fromhex(mac.replace(":", ""))
        + ipaddress.ip_address(ip).packed
        + bytes(6)
        + ipaddress.ip_address("10.0.0.77").packed
    )


def packets(spark, frames: list[bytes], iface: str = "eth0"):
    start = datetime.datetime(2024, 1, 1)
    rows = [
        (i, start + datetime.timedelta(seconds=i), iface, frame) for i, frame in enumerate(frames)
    ]
    return spark.createDataFrame(rows, PACKETS_RAW)


def in_order(df, *columns):
    return [tuple(r)[1:] for r in df.select("packet_id", *columns).orderBy("packet_id").collect()]
