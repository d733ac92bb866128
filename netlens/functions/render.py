"""Bytes as text: hex streams, printable rendering, padding, payload text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_stream(data: Column) -> Column:
    """Lower-case hex pairs separated by single spaces; empty bytes give ``''``."""
    return F.rtrim(F.regexp_replace(F.lower(F.hex(data)), "(..)", "$1 "))


def hex_to_bytes(text: Column, strict: bool = True) -> Column:
    """Bytes of a hex text, all white space ignored.

    An odd number of digits is an error, or NULL with ``strict=False``.  Text
    that is not hex gives NULL in both modes.
    """
    digits = F.regexp_replace(text, r"\s+", "")
    odd = F.length(digits) % 2 != 0
    if strict:
        bad = F.raise_error(F.concat(F.lit("Invalid hex string: "), digits)).cast("binary")
    else:
        bad = F.lit(None).cast("binary")
    return F.when(odd, bad).otherwise(F.unhex(digits))


def printable(data: Column) -> Column:
    r"""Bytes 32-126 as characters, every other byte as ``\xHH``.

    The bytes are read as ISO-8859-1 (one character per byte) and cut into
    runs of printable and other bytes, so the lambda runs once per run and not
    once per byte.
    """
    runs = F.regexp_extract_all(
        F.decode(data, "ISO-8859-1"), F.lit("[ -~]+|[^ -~]+"), F.lit(0)
    )

    def escape(run: Column) -> Column:
        digits = F.hex(F.encode(run, "ISO-8859-1"))
        return F.regexp_replace(digits, "(..)", r"\\x$1")

    shown = F.transform(
        runs, lambda r: F.when(F.rlike(r, F.lit("^[ -~]")), r).otherwise(escape(r))
    )
    return F.array_join(shown, "")


def ethernet_pad(raw: Column) -> Column:
    """Padding bytes, taken at fixed offset 54 whatever the real headers are.

    The pad is wanted up to frame length 64 and must fit behind offset 54, so
    it is non-empty exactly for frames of 59 to 63 bytes.
    """
    size = F.length(raw)
    return F.when(
        size.between(59, 63), F.substring(raw, F.lit(55), F.lit(64) - size)
    ).when(size.isNotNull(), F.lit(b""))


def ethernet_pad_hex(raw: Column) -> Column:
    """Hex stream of the padding; at most five bytes, so no regular expression."""
    return hex_stream(ethernet_pad(raw))


def payload_text(is_ipv4_tcp: Column, payload: Column, raw: Column) -> Column:
    """Readable text of a frame.

    IPv4 TCP: a payload containing ``HTTP`` as UTF-8 text (malformed sequences
    become U+FFFD), any other payload through :func:`printable`; a missing
    payload is empty.  All other frames: :func:`printable` of the whole frame.
    """
    body = F.coalesce(payload, F.lit(b""))
    is_http = F.contains(body, F.lit(b"HTTP"))
    in_ipv4_tcp = F.coalesce(is_ipv4_tcp, F.lit(False))
    shown = F.when(in_ipv4_tcp, body).otherwise(raw)
    return F.when(
        in_ipv4_tcp & is_http, F.make_valid_utf8(body.cast("string"))
    ).otherwise(printable(shown))
