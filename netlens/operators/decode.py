"""Packet decode: a few projections over ``raw BINARY``, no UDF.

The numbers that everything else depends on (lengths, offsets, protocol,
ports, flags) are computed first, each once.  They then pass through a
one-element ``inline``, which Catalyst does not push filters through: without
it, a filter on a decoded field would be rewritten in terms of ``raw`` and the
whole decode would be computed twice, in an expression too large to compile.
Filters on columns that come with the packet (time, interface) still reach the
scan.  Text fields are plain expressions after that point and are pruned when
a query does not use them, so a query on ports renders no address.

A layer is present only if all of its fixed header lies inside the captured
bytes; a truncated header makes the layer absent, never half filled.
Up to two 802.1Q or 802.1ad tags are stepped over: ``eth_type`` is the type in
the Ethernet header, the layers are those behind the tags.  IPv6 extension
headers are followed to their end; ``ipv6_next_header`` is the field of the
fixed header.  Non-first fragments have no transport layer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import ipv4_text, ipv6_text, mac_text, u8, u16
from ..functions.names import protocol_text
from ..schema import FLAT_FIELDS, LAYER_MARK, LAYERS

UNKNOWN_PROTOCOL = "Unknown Protocol"

# What passes the fence: the numeric header fields and three offsets.
_NUMBERS = [
    "len",
    "eth_type",
    "ipv4_proto",
    "ipv4_ihl",
    "ipv6_next_header",
    "tcp_src_port",
    "tcp_dst_port",
    "udp_src_port",
    "udp_dst_port",
    "_flags",
    "_data",
    "_end",
    "_type",
    "_net",
]

# Tag types, and IPv6 extension headers by the unit of their length.
TAGS = f"({0x8100}, {0x88A8})"
OPTIONS, FRAGMENT, AUTHENTICATION = (0, 43, 60, 135), 44, 51
EXTENSIONS = str((*OPTIONS, FRAGMENT, AUTHENTICATION))


def _last_header(start: str) -> str:
    """The chain of extension headers from offset ``start``, walked to its end.

    Gives the number of the first header that is none (``n``), its offset (``o``) and whether the
    packet is a later fragment (``f``).  A header takes eight bytes at least, which bounds the
    steps by the length of the frame; a truncated one ends the walk.
    """
    n, size = u8("raw", "s.o"), u8("raw", "s.o + 1")

    def moved(by: str, fragment: str = "s.f") -> str:
        return f"named_struct('n', {n}, 'o', s.o + {by}, 'f', {fragment})"

    return f"""aggregate(sequence(1, greatest(1, (len - {start}) div 8)),
        named_struct('n', ipv6_next_header, 'o', {start}, 'f', false),
        (s, i) -> case
            when s.n in {OPTIONS} and s.o + 7 <= len then {moved(f'({size} + 1) * 8')}
            when s.n = {FRAGMENT} and s.o + 7 <= len then {moved('8', f"s.f or {u16('raw', 's.o + 2')} >= 8")}
            when s.n = {AUTHENTICATION} and s.o + 7 <= len then {moved(f'({size} + 2) * 4')}
            else s end)"""


def packet_length(raw: Column) -> Column:
    """Captured length in bytes, link header included."""
    return F.length(raw)


def _add(df: DataFrame, **columns: str) -> DataFrame:
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def _numbers(df: DataFrame) -> DataFrame:
    """Add the columns of ``_NUMBERS``."""
    df = _add(df, len="length(raw)")
    df = _add(df, eth_type=f"if(len >= 14, {u16('raw', 13)}, null)")

    # Tags: the type behind them, and where the network layer starts.
    df = _add(df, _inner=f"if(eth_type in {TAGS} and len >= 18, {u16('raw', 17)}, null)")
    df = _add(
        df,
        _net=f"case when _inner in {TAGS} then 23 when eth_type in {TAGS} then 19 else 15 end",
        _type=f"""case when _inner in {TAGS} then if(len >= 22, {u16('raw', 21)}, null)
            when eth_type in {TAGS} then _inner else eth_type end""",
    )

    # Network layer: presence, where the transport header starts, and where the
    # datagram ends (trailing link padding is not payload).
    df = _add(
        df,
        _first=f"""if(_type = {0x0800} and len >= _net + 19 or _type = {0x86DD} and len >= _net + 39,
            {u8('raw', '_net')}, null)""",
    )
    df = _add(
        df,
        _header=f"if(_type = {0x0800} and _first between {0x45} and {0x4F}, (_first - 64) * 4, null)",
        _v6=f"_type = {0x86DD} and _first between {0x60} and {0x6F}",
    )
    df = _add(df, ipv4_ihl="if(_header + _net - 1 <= len, _header, null)")
    # Length 0 is written by offloading hardware and for jumbograms: up to the end.
    df = _add(
        df,
        ipv4_proto=f"if(ipv4_ihl is not null, {u8('raw', '_net + 9')}, null)",
        ipv6_next_header=f"if(_v6, {u8('raw', '_net + 6')}, null)",
        _end=f"""least(len, case
            when ipv4_ihl is not null then coalesce(nullif({u16('raw', '_net + 2')}, 0) + _net - 1, len)
            when _v6 then coalesce(nullif({u16('raw', '_net + 4')}, 0) + _net + 39, len) end)""",
    )
    df = _add(df, _ext=f"if(ipv6_next_header in {EXTENSIONS}, {_last_header('_net + 40')}, null)")
    df = _add(
        df,
        _proto="coalesce(ipv4_proto, _ext.n, ipv6_next_header)",
        _l4=f"""case when ipv4_ihl is not null and {u16('raw', '_net + 6')} & {0x1FFF} = 0 then ipv4_ihl + _net
            when _ext is not null then if(_ext.f, null, _ext.o)
            when _v6 then _net + 40 end""",
    )

    # Transport layer.
    df = _add(
        df,
        _doff=f"""if(_proto = 6 and _end >= _l4 + 19,
            shiftright({u8('raw', '_l4 + 12')}, 4) * 4, null)""",
        _udp="_proto = 17 and _end >= _l4 + 7",
    )
    df = _add(df, _tcp="_doff >= 20 and _end >= _l4 - 1 + _doff")
    return _add(
        df,
        tcp_src_port=f"if(_tcp, {u16('raw', '_l4')}, null)",
        tcp_dst_port=f"if(_tcp, {u16('raw', '_l4 + 2')}, null)",
        _flags=f"if(_tcp, {u8('raw', '_l4 + 13')}, null)",
        _data="if(_tcp, _l4 + _doff, null)",
        udp_src_port=f"if(_udp, {u16('raw', '_l4')}, null)",
        udp_dst_port=f"if(_udp, {u16('raw', '_l4 + 2')}, null)",
    )


def decode_fields(df: DataFrame) -> DataFrame:
    """Add ``len`` and the flat header fields to a DataFrame with ``raw``."""
    fence = F.expr(f"inline(array(struct({', '.join(_NUMBERS)})))")
    df = _numbers(df).select(*df.columns, fence)

    def only(condition: str, **columns: str) -> dict[str, str]:
        return {name: f"if({condition}, {text}, null)" for name, text in columns.items()}

    return _add(
        df,
        **only("eth_type is not null", eth_dst=mac_text("raw", 1), eth_src=mac_text("raw", 7)),
        **only(
            "_type <= 1500 and len >= _net + 2",
            llc_dsap=u8("raw", "_net"),
            llc_ssap=u8("raw", "_net + 1"),
            llc_control=u8("raw", "_net + 2"),
        ),
        **only(
            "ipv4_proto is not null",
            ipv4_src=ipv4_text("raw", "_net + 12"),
            ipv4_dst=ipv4_text("raw", "_net + 16"),
        ),
        **only(
            "ipv6_next_header is not null",
            ipv6_src=ipv6_text("raw", "_net + 8"),
            ipv6_dst=ipv6_text("raw", "_net + 24"),
        ),
        **only(
            f"_type = {0x0806} and len >= _net + 27",
            arp_op=u16("raw", "_net + 6"),
            arp_sha=mac_text("raw", "_net + 8"),
            arp_spa=ipv4_text("raw", "_net + 14"),
            arp_tha=mac_text("raw", "_net + 18"),
            arp_tpa=ipv4_text("raw", "_net + 24"),
        ),
        tcp_syn="_flags & 2 = 2",
        tcp_ack="_flags & 16 = 16",
        tcp_fin="_flags & 1 = 1",
        tcp_psh="_flags & 8 = 8",
        tcp_payload="if(_end >= _data, substring(raw, _data, _end - _data + 1), null)",
    ).drop("_flags", "_data", "_end", "_type", "_net")


def _transport(df: DataFrame) -> DataFrame:
    """TCP and UDP packets with addresses, ports and what the transport header says, read from ``raw``."""
    places = {"v4": "ipv4_ihl is not null", "proto": "_proto", "src_port": "coalesce(tcp_src_port, udp_src_port)",
              "dst_port": "coalesce(tcp_dst_port, udp_dst_port)", "flags": "_flags", "size": "len",
              "net": "_net", "l4": "_l4", "data": "_data", "last": "_end"}
    fence = ", ".join(f"{text} as {name}" for name, text in places.items())
    placed = _numbers(df.select("packet_id", "ts", "raw")).select("packet_id", "ts", "raw", F.expr(f"inline(array(struct({fence})))"))

    def address(v4: str, v6: str) -> str:
        return f"if(v4, {ipv4_text('raw', f'net + {v4}')}, {ipv6_text('raw', f'net + {v6}')})"

    ends = {"src_ip": address("12", "8"), "dst_ip": address("16", "24")}
    return placed.where("src_port is not null").withColumns({name: F.expr(text) for name, text in ends.items()})


def tcp_segments(df: DataFrame) -> DataFrame:
    """TCP packets of raw or stored form with what reassembly needs.

    Columns: packet_id, ts, src_ip, src_port, dst_ip, dst_port, seq, syn, payload (null if none).
    """
    return _transport(df).where("proto = 6").select(
        "packet_id",
        "ts",
        *("src_ip", "src_port", "dst_ip", "dst_port"),
        F.expr("cast(conv(hex(substring(raw, l4 + 4, 4)), 16, 10) as bigint)").alias("seq"),
        F.expr("flags & 2 = 2").alias("syn"),
        F.expr("if(last >= data, substring(raw, data, last - data + 1), null)").alias("payload"),
    )


def transport_packets(df: DataFrame) -> DataFrame:
    """TCP and UDP packets of raw or stored form: packet_id, ts, proto, the four ends, size (bytes of
    the frame), opens (a SYN without ACK) and closes (a FIN or RST); both false for UDP."""
    return _transport(df).select(
        *("packet_id", "ts", "proto", "src_ip", "src_port", "dst_ip", "dst_port", "size"),
        F.expr("coalesce(flags & 18 = 2, false)").alias("opens"),
        F.expr("coalesce(flags & 5 > 0, false)").alias("closes"),
    )


def has_layer(layer: str) -> Column:
    """True where ``layer`` is present (flat form); never null."""
    return F.col(LAYER_MARK[layer]).isNotNull()


def pack_layers(df: DataFrame) -> DataFrame:
    """Flat form to layered form: one nullable struct per layer."""
    rest = [c for c in df.columns if c not in FLAT_FIELDS]
    structs = []
    for layer, parts in LAYERS.items():
        named = ", ".join(f"'{p.name}', {layer}_{p.name}" for p in parts)
        structs.append(
            f"if({LAYER_MARK[layer]} is not null, named_struct({named}), null) as {layer}"
        )
    return df.select(*rest, *map(F.expr, structs))


def unpack_layers(df: DataFrame) -> DataFrame:
    """Layered form to flat form."""
    rest = [c for c in df.columns if c not in LAYERS]
    flat = [
        f"{layer}.{p.name} as {layer}_{p.name}" for layer, parts in LAYERS.items() for p in parts
    ]
    return df.select(*rest, *map(F.expr, flat))


def fields(df: DataFrame) -> DataFrame:
    """Flat form of raw, layered or already flat packets."""
    columns = set(df.columns)
    if "eth_type" in columns:
        return df
    if "eth" in columns:
        return unpack_layers(df)
    return decode_fields(df)


def decode(df: DataFrame) -> DataFrame:
    """Layered form of raw or flat packets."""
    return df if "eth" in df.columns else pack_layers(fields(df))


def source_ip() -> Column:
    """IPv4 source, else IPv6 source, else null."""
    return F.coalesce("ipv4_src", "ipv6_src")


def destination_ip() -> Column:
    """IPv4 destination, else IPv6 destination, else null."""
    return F.coalesce("ipv4_dst", "ipv6_dst")


def has_ip() -> Column:
    """True where :func:`source_ip` is not null, without rendering it."""
    return has_layer("ipv4") | has_layer("ipv6")


def protocol_name() -> Column:
    """Protocol of the IPv4 header, else of the IPv6 header, else a fixed text."""
    return F.coalesce(
        protocol_text(F.col("ipv4_proto")),
        protocol_text(F.col("ipv6_next_header")),
        F.lit(UNKNOWN_PROTOCOL),
    )


def resolve_ips(df: DataFrame) -> DataFrame:
    """Add ``sourceIp`` and ``destinationIp``: IPv4, else IPv6, else null."""
    return fields(df).withColumns(
        {"sourceIp": source_ip(), "destinationIp": destination_ip()}
    )
