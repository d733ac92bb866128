"""Certificates of a TLS handshake (up to version 1.2, where they are sent in the clear)."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

# Fixed values of TLS and of X.509 in DER.
HANDSHAKE_RECORD, CERTIFICATE_MESSAGE = 22, 11
SEQUENCE, INTEGER, OID, UTC_TIME, VERSION_TAG = 0x30, 0x02, 0x06, 0x17, 0xA0
NAME_PARTS = {b"\x55\x04\x03": "CN", b"\x55\x04\x06": "C", b"\x55\x04\x07": "L", b"\x55\x04\x08": "ST", b"\x55\x04\x0a": "O", b"\x55\x04\x0b": "OU"}


def handshake_bytes(stream: bytes) -> bytes:
    """The handshake messages of a stream of TLS records, up to the first other record or a cut one."""
    out, at = [], 0
    while at + 5 <= len(stream) and stream[at] == HANDSHAKE_RECORD and stream[at + 1] == 3:
        size = int.from_bytes(stream[at + 3 : at + 5])
        if at + 5 + size > len(stream):
            break
        out.append(stream[at + 5 : at + 5 + size])
        at += 5 + size
    return b"".join(out)


def certificate_list(stream: bytes) -> list[bytes]:
    """The certificates (DER) of the first certificate message; none if it is not there or cut."""
    messages, at = handshake_bytes(stream), 0
    while at + 4 <= len(messages):
        size = int.from_bytes(messages[at + 1 : at + 4])
        body = messages[at + 4 : at + 4 + size]
        if len(body) < size:
            return []
        if messages[at] == CERTIFICATE_MESSAGE:
            found, i = [], 3
            while i + 3 <= len(body):
                n = int.from_bytes(body[i : i + 3])
                if i + 3 + n > len(body):
                    break
                found.append(body[i + 3 : i + 3 + n])
                i += 3 + n
            return found
        at += 4 + size
    return []


def elements(der: bytes) -> Iterator[tuple[int, bytes]]:
    """Tag and content of the DER elements one after another; ValueError where they are cut."""
    at, end = 0, len(der)
    while at < end:
        begin = at + 2
        if begin > end:
            raise ValueError("cut element")
        size = der[at + 1]
        if size >= 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4:
                raise ValueError("length of an element")
            size, begin = int.from_bytes(der[begin : begin + width]), begin + width
        if begin + size > end:
            raise ValueError("cut element")
        yield der[at], der[begin : begin + size]
        at = begin + size


def _name(der: bytes) -> tuple[str, str | None]:
    """A distinguished name as text, and its last common name."""
    parts, common = [], None
    for _, one in elements(der):
        for _, pair in elements(one):
            (_, kind), (tag, value) = list(elements(pair))[:2]
            text = value.decode("utf-16-be" if tag == 0x1E else "utf-8", "replace")
            label = NAME_PARTS.get(kind, kind.hex())
            parts.append(f"{label}={text}")
            common = text if label == "CN" else common
    return ", ".join(parts), common


def _time(tag: int, value: bytes) -> datetime.datetime:
    text = value.decode("ascii")
    if tag == UTC_TIME:  # two digits of the year: 1950 to 2049
        text = ("19" if text[:2] >= "50" else "20") + text
    if len(text) == 15 and text[14] == "Z" and text[:14].isdecimal():
        return datetime.datetime(int(text[:4]), *(int(text[i : i + 2]) for i in range(4, 14, 2)))
    return datetime.datetime.strptime(text, "%Y%m%d%H%M%SZ")


def certificate(der: bytes) -> dict | None:
    """Issuer, subject, serial number and validity; None if the bytes are no certificate."""
    try:
        outer = list(elements(der))
        signed = list(elements(next(elements(outer[0][1]))[1]))
        if signed[0][0] == VERSION_TAG:
            signed = signed[1:]
        (_, serial), _, (_, issuer), (_, validity), (_, subject) = signed[:5]
        begin, end = (str(_time(*t)) for t in list(elements(validity))[:2])
        issuer, issuer_cn = _name(issuer)
        return {"issuer": issuer, "issuer_cn": issuer_cn, "subject": _name(subject)[0], "serial": serial.hex(), "not_before": begin, "not_after": end}
    except (ValueError, IndexError, StopIteration):
        return None


def certificates(stream: bytes) -> list[dict]:
    """The readable certificates at the beginning of a server's bytes, the server's own first."""
    return [c for d in certificate_list(stream) if (c := certificate(d))]
