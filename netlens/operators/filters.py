"""Filters on interface, host and capture length, and the interface list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import ip_argument, normal_ip
from .decode import destination_ip, fields, has_layer, source_ip
from .lookup import exists_flag


def list_interfaces(df: DataFrame) -> DataFrame:
    """Interfaces with the label shown for them: description, or name if empty."""
    return (
        df.select("name", "description")
        .distinct()
        .withColumn(
            "label", F.coalesce(F.nullif("description", F.lit("")), F.col("name"))
        )
    )


def select_interface(
    df: DataFrame, name: str, interfaces: DataFrame | None = None
) -> DataFrame:
    """Packets of one interface; a name that the table of interfaces lacks is an error.

    Without a table the interfaces are those that occur in ``df``, which costs a scan of that
    column until the first packet is found.  A stream has no such list and needs the table.
    """
    if interfaces is None:
        if df.isStreaming:
            raise ValueError("choosing an interface of a stream needs the table of interfaces")
        known = df.select(F.col("iface").alias("name"))
    else:
        known = interfaces
    if known.filter(F.col("name") == name).isEmpty():
        raise ValueError(f"interface {name!r} is not among the known ones")
    return df.filter(F.col("iface") == name)


def truncate_snaplen(df: DataFrame, n: int | None) -> DataFrame:
    """Keep at most ``n`` bytes of each frame, all of it for None; decode sees only those."""
    return df if n is None else df.withColumn("raw", F.substring("raw", 1, n))


def _stored_addresses(df: DataFrame) -> bool:
    return {"src_ip", "dst_ip", "arp"} <= set(df.columns)


def _touches(df: DataFrame, ip: str) -> Column:
    if _stored_addresses(df):
        ends = ["src_ip", "dst_ip", "arp.spa", "arp.tpa"]
    else:
        ends = [
            "ipv4_src", "ipv4_dst", "ipv6_src", "ipv6_dst", "arp_spa", "arp_tpa",
        ]
    result = F.lit(False)
    for end in ends:
        result = result | (F.col(end) == ip)
    return result


def host_filter(df: DataFrame, ip: str | None) -> DataFrame:
    """Frames to or from ``ip``, ARP included; no filter for null or empty.

    The address may be in any usual spelling; a text that is none is an error.  On stored packets the test is on plain columns and is pushed to the scan.
    """
    if not ip:
        return df
    ip = ip_argument(ip)
    if not _stored_addresses(df):
        df = fields(df)
    return df.filter(_touches(df, ip))


def host_set_filter(df: DataFrame, hosts: DataFrame, ip_col: str = "ip", **options) -> DataFrame:
    """Frames to or from any of many hosts, as two equi joins without a union.

    A frame is IP or ARP, never both, so each end is one key.  Hosts may be in any spelling.
    """
    stored = _stored_addresses(df)
    if stored:
        src, dst = F.coalesce("src_ip", "arp.spa"), F.coalesce("dst_ip", "arp.tpa")
    else:
        df = fields(df)
        src, dst = F.coalesce(source_ip(), "arp_spa"), F.coalesce(destination_ip(), "arp_tpa")
    hosts = hosts.select(normal_ip(F.col(ip_col)).alias(ip_col))
    df = df.withColumns({"_src": src, "_dst": dst})
    df = exists_flag(df, hosts, "_src", ip_col, "_src_hit", "packet_id", **options)
    df = exists_flag(df, hosts, "_dst", ip_col, "_dst_hit", "packet_id", **options)
    return df.filter(F.col("_src_hit") | F.col("_dst_hit")).drop(
        "_src", "_dst", "_src_hit", "_dst_hit"
    )


def only_layer(df: DataFrame, layer: str) -> DataFrame:
    """Packets that have ``layer``, in flat form."""
    return fields(df).filter(has_layer(layer))
