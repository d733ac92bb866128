"""Lookups by network: the answer of the longest prefix that an address has.

A prefix of n bits is an equality on the first n bits.  Each distinct address becomes one row for
every length that the table has prefixes of (at most 33 for IPv4, 129 for IPv6), which meets the
table in one equi join; of what it finds the longest stays.  Packets then meet one row for each
address, like any other lookup.  No range join, and nothing grows with packets times networks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import ip_bits, normal_ip
from .lookup import lookup_join


def _fenced(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that no filter is pushed through, which would copy their long expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def networks(table: DataFrame, prefix_col: str = "prefix") -> DataFrame:
    """``table`` with ``net_bits`` (the prefix's own bits as text), ``net_family`` (all bits of its
    kind) and ``net_length``.

    A prefix is ``address/length`` in any spelling of the address; without a length it is one
    address.  Bits behind the length do not count.  What is no prefix is left out.
    """
    parts = F.split(F.trim(prefix_col), "/")
    given = F.get(parts, 1)
    length = F.when(F.size(parts) == 1, F.length("_bits")).when(given.rlike(r"^\d{1,3}$"), given.cast("int"))
    named = _fenced(table, _ip=normal_ip(F.get(parts, 0)))
    named = _fenced(named, _bits=ip_bits(F.col("_ip"))).drop("_ip")
    named = named.withColumn("net_length", length).where((F.size(parts) <= 2) & (F.col("net_length") <= F.length("_bits")))
    return named.withColumns({"net_family": F.length("_bits"), "net_bits": F.expr("left(_bits, net_length)")}).drop("_bits")


def ranges_to_prefixes(table: DataFrame, first_col: str = "first", last_col: str = "last", prefix_col: str = "prefix") -> DataFrame:
    """IPv4 ranges, both ends included, as the prefixes that cover them: one row for each.

    Of blocks of 2^k addresses a range needs at most one at either end: those that no block of
    twice the size inside the range covers.  What is no range is left out.
    """
    rows = _fenced(table, _first=ip_bits(F.trim(first_col)), _last=ip_bits(F.trim(last_col)))
    rows = rows.where((F.length("_first") == 32) & (F.length("_last") == 32))
    low, high = (F.conv(c, 2, 10).cast("long") for c in ("_first", "_last"))
    rows = rows.withColumns({"_low": low, "_end": high + 1}).where("_low < _end").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(32))))
    rows = rows.withColumns({"_l": F.expr("(_low + shiftleft(1L, _k) - 1) div shiftleft(1L, _k)"), "_r": F.expr("_end div shiftleft(1L, _k)")})
    rows = rows.where("_l < _r")
    ends = F.array_compact(F.array(F.expr("if(_l % 2 = 1, _l, null)"), F.expr("if(_r % 2 = 1, _r - 1, null)"), F.expr("if(_k = 32, 0L, null)")))
    rows = rows.withColumn("_block", F.explode(F.array_distinct(ends))).withColumn("_at", F.expr("shiftleft(_block, _k)"))
    quad = F.concat_ws(".", *[F.expr(f"(shiftright(_at, {s}) & 255)") for s in (24, 16, 8, 0)])
    rows = rows.withColumn(prefix_col, F.concat(quad, F.lit("/"), (F.lit(32) - F.col("_k")).cast("string")))
    return rows.select(*table.columns, prefix_col)


def longest_prefix(ips: DataFrame, table: DataFrame, taken: list[str], prefix_col: str = "prefix") -> DataFrame:
    """``ip, net_length`` and the columns ``taken`` of the longest prefix of each distinct address of
    ``ips(ip)``; addresses without one are left out.  Of equal prefixes the least values stay.

    The result is a lookup table: it can stand for ``whois`` or ``geo`` in ``Lookups``.
    """
    nets = networks(table, prefix_col).groupBy("net_family", "net_length", "net_bits").agg(F.min(F.struct(*taken)).alias("_found"))
    lengths = nets.groupBy("net_family").agg(F.collect_set("net_length").alias("_lengths"))  # at most 33 and 129
    wanted = _fenced(ips.select(F.col("ip").alias("_given")), ip=normal_ip(F.col("_given"))).select("ip").distinct()
    wanted = _fenced(wanted, _bits=ip_bits(F.col("ip"))).where("_bits is not null")
    rows = wanted.withColumn("net_family", F.length("_bits")).join(lengths, "net_family").withColumn("net_length", F.explode("_lengths"))
    rows = rows.withColumn("net_bits", F.expr("left(_bits, net_length)")).select("ip", "net_family", "net_length", "net_bits")
    met = rows.join(nets, ["net_family", "net_length", "net_bits"])
    best = met.groupBy("ip").agg(F.max(F.struct("net_length", "_found")).alias("_best"))
    return best.select("ip", "_best.net_length", *[F.col(f"_best._found.{c}").alias(c) for c in taken])


def match_prefixes(df: DataFrame, ip_col: str, table: DataFrame, taken: list[str], prefix_col: str = "prefix", spread_by: str = "packet_id") -> DataFrame:
    """Add the columns ``taken`` of the longest prefix of ``ip_col``; null where there is none."""
    found = longest_prefix(df.select(F.col(ip_col).alias("ip")).where("ip is not null"), table, taken, prefix_col)
    return lookup_join(df, found.drop("net_length"), ip_col, "ip", spread_by)
