"""One spelling for IP addresses.

Decoded addresses are dotted quads, and eight lower-case groups without leading zeros or ``::``.
``ip_argument`` brings a caller's text into that form on the driver; ``normal_ip`` does the same
for a column of a lookup table, in built-in expressions.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F


def ip_argument(text: str) -> str:
    """The decoded form of an address in any usual spelling; an error if it is none."""
    address = ipaddress.ip_address(text.strip())
    if address.version == 4:
        return str(address)
    packed = address.packed
    return ":".join(f"{packed[i] << 8 | packed[i + 1]:x}" for i in range(0, 16, 2))


def _groups(text: Column) -> Column:
    """Groups of one side of a ``::``, leading zeros dropped; none for the empty text."""
    split = F.filter(F.split(text, ":"), lambda g: g != "")
    return F.transform(split, lambda g: F.regexp_replace(g, "^0+(?=.)", ""))


def normal_ip(text: Column) -> Column:
    """The decoded form of an IPv6 text; any other text without the white space around it."""
    lower = F.lower(F.trim(text))
    # a dotted quad at the end stands for the last two groups
    quad = F.split(F.regexp_extract(lower, r"((?:\d+\.){3}\d+)$", 1), r"\.")

    def two(i: int) -> Column:
        return F.lower(F.hex(F.get(quad, i).cast("long") * 256 + F.get(quad, i + 1).cast("long")))

    whole = F.when(
        lower.rlike(r":(\d+\.){3}\d+$"),
        F.concat(F.regexp_replace(lower, r"(\d+\.){3}\d+$", ""), two(0), F.lit(":"), two(2)),
    ).otherwise(lower)
    sides = F.split(whole, "::", 2)
    left, right = _groups(F.get(sides, 0)), F.coalesce(_groups(F.get(sides, 1)), F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0)))
    filled = F.when(whole.contains("::"), F.concat(left, zeros, right)).otherwise(left)
    return F.when(lower.contains(":"), F.array_join(filled, ":")).otherwise(F.trim(text))


def ip_bits(ip: Column) -> Column:
    """The bits of an address in decoded form as text, 32 or 128 of them; null for any other text."""
    quad = F.array_join(F.transform(F.split(ip, r"\."), lambda g: F.lpad(F.conv(g, 10, 2), 8, "0")), "")
    groups = F.array_join(F.transform(F.split(ip, ":"), lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
    one = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    return F.when(ip.rlike(rf"^(?:{one}\.){{3}}{one}$"), quad).when(ip.rlike(r"^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$"), groups)
