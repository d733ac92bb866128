"""Projections for display and for the log: packet views, log records, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import ethertype_text, octet_text
from ..functions.render import ethernet_pad_hex, hex_stream, payload_text
from ..schema import LOG_MAX_LENGTH
from .decode import destination_ip, fields, has_ip, has_layer, protocol_name, source_ip
from .rules import Rule, loggable

DETAILS_LENGTH = LOG_MAX_LENGTH["details"]


def packet_view(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The nested six-field view of each packet; ``keep`` adds columns of ``df``."""
    return fields(df).select(
        *(keep or []),
        F.struct(
            F.col("eth_dst").alias("destinationAddress"),
            F.col("eth_src").alias("sourceAddress"),
            ethertype_text(F.col("eth_type")).alias("type"),
        ).alias("ethernetHeader"),
        F.when(
            has_layer("llc"),
            F.struct(
                octet_text(F.col("llc_dsap")).alias("dsap"),
                octet_text(F.col("llc_ssap")).alias("ssap"),
                octet_text(F.col("llc_control")).alias("control"),
            ),
        ).alias("llcHeader"),
        hex_stream(F.col("raw")).alias("dataHexStream"),
        ethernet_pad_hex(F.col("raw")).alias("ethernetPadHexStream"),
        source_ip().alias("sourceIpAddress"),
        destination_ip().alias("destinationIpAddress"),
    )


def visible_packets(view: DataFrame) -> DataFrame:
    """Rows with a destination IP; the packet table hides the others."""
    return view.filter(F.col("destinationIpAddress") != "")


def display_packets(view: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The ten columns of the packet table, empty text for what is missing."""

    def shown(column: str, name: str) -> Column:
        return F.coalesce(F.col(column), F.lit("")).alias(name)

    return visible_packets(view).select(
        *(keep or []),
        shown("ethernetHeader.destinationAddress", "destination_host"),
        shown("destinationIpAddress", "destination_ip"),
        shown("ethernetHeader.sourceAddress", "source_host"),
        shown("sourceIpAddress", "source_ip"),
        shown("ethernetHeader.type", "type"),
        shown("llcHeader.dsap", "llc_dsap"),
        shown("llcHeader.ssap", "llc_ssap"),
        shown("llcHeader.control", "llc_control"),
        shown("dataHexStream", "data"),
        shown("ethernetPadHexStream", "ethernet_pad"),
    )


def count_records(df: DataFrame) -> DataFrame:
    """Number of rows, hidden ones included."""
    return df.agg(F.count("*").alias("n"))


def readable_payload(df: DataFrame) -> DataFrame:
    """Add ``payload_text`` (see :func:`netlens.functions.render.payload_text`)."""
    df = fields(df)
    text = payload_text(
        has_layer("ipv4") & has_layer("tcp"), F.col("tcp_payload"), F.col("raw")
    )
    return df.withColumn("payload_text", text)


def details_text(limit: int = DETAILS_LENGTH) -> Column:
    """Text of a packet: its decoded fields, then its bytes; cut to ``limit``.

    Only as many bytes are rendered as can show within the limit; the text is
    the same as if all had been.
    """

    def part(label: str, column: Column) -> Column:
        return F.concat(F.lit(label), column.cast("string"))

    fields_text = F.concat_ws(
        " ",
        part("len=", F.col("len")),
        part("eth=", F.concat_ws(">", "eth_src", "eth_dst")),
        part("type=", ethertype_text(F.col("eth_type"))),
        F.when(has_ip(), part("ip=", F.concat_ws(">", source_ip(), destination_ip()))),
        F.when(has_ip(), part("proto=", protocol_name())),
        part("tcp=", F.concat(F.col("tcp_src_port"), F.lit(">"), F.col("tcp_dst_port"))),
        part("udp=", F.concat(F.col("udp_src_port"), F.lit(">"), F.col("udp_dst_port"))),
        part("arp=", F.concat(F.col("arp_spa"), F.lit("@"), F.col("arp_sha"))),
    )
    bytes_text = hex_stream(F.substring("raw", 1, limit // 3 + 1))
    return F.left(F.concat_ws(" | ", fields_text, bytes_text), F.lit(limit))


def log_record(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The log row of each packet; MACs and EtherType only if it has an IP layer.

    ``timestamp`` is the capture time of the packet.
    """
    with_ip = has_ip()
    return fields(df).select(
        *(keep or []),
        F.col("ts").alias("timestamp"),
        source_ip().alias("sourceip"),
        F.when(with_ip, F.col("eth_src")).alias("sourcemac"),
        destination_ip().alias("destinationip"),
        F.when(with_ip, F.col("eth_dst")).alias("destinationmac"),
        protocol_name().alias("protocol"),
        F.when(with_ip, ethertype_text(F.col("eth_type"))).alias("ipversion"),
        details_text().alias("details"),
    )


def log_records(
    df: DataFrame,
    rules: str | list[Rule] = "base",
    keep: list[str] | None = None,
    **options,
) -> DataFrame:
    """Log rows of the anomalous packets; options as for ``rules.loggable``."""
    return log_record(loggable(df, rules, **options), keep)


def display_logs(logs: DataFrame) -> DataFrame:
    """The eight columns of the log table in display order, keyed by id."""
    return logs.select(
        "id",
        "timestamp",
        "sourceip",
        "sourcemac",
        "destinationip",
        "destinationmac",
        "ipversion",
        "protocol",
        "details",
    )


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row in ``value``; nulls are written, not left out."""
    if "created_at" in df.columns:
        df = df.withColumnRenamed("created_at", "createdAt")
    return df.select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")
    )
