"""Table schemas shared by every module.

A decoded packet exists in two equivalent forms.  The *layered* form keeps one
nullable struct per protocol layer (null struct = layer absent) and is what
gets stored.  The *flat* form has one column per header field, named
``<layer>_<field>``; rules and views are written against it because Catalyst
prunes unused plain columns even in the middle of a long projection chain.
"""

from __future__ import annotations

from pyspark.sql import types as T

PACKETS_RAW = T.StructType(
    [
        T.StructField("packet_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("iface", T.StringType()),
        T.StructField("raw", T.BinaryType()),
    ]
)


def _layer(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()

LAYERS: dict[str, T.StructType] = {
    "eth": _layer(dst=_S, src=_S, type=_I),
    "llc": _layer(dsap=_I, ssap=_I, control=_I),
    "ipv4": _layer(src=_S, dst=_S, proto=_I, ihl=_I),
    "ipv6": _layer(src=_S, dst=_S, next_header=_I),
    "arp": _layer(spa=_S, sha=_S, tpa=_S, tha=_S, op=_I),
    "tcp": _layer(
        src_port=_I, dst_port=_I, syn=_B, ack=_B, fin=_B, psh=_B, payload=T.BinaryType()
    ),
    "udp": _layer(src_port=_I, dst_port=_I),
}

# The field that is never null when its layer is there.
LAYER_MARK = {
    "eth": "eth_type",
    "llc": "llc_dsap",
    "ipv4": "ipv4_proto",
    "ipv6": "ipv6_next_header",
    "arp": "arp_op",
    "tcp": "tcp_src_port",
    "udp": "udp_src_port",
}

FLAT_FIELDS = [f"{layer}_{f.name}" for layer, st in LAYERS.items() for f in st]

# The stored form also carries plain address columns, so that host filters are
# pushed into the parquet scan, and the two partition columns.
PACKETS_STORED = T.StructType(
    [
        T.StructField("packet_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("len", T.IntegerType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        *[T.StructField(layer, st) for layer, st in LAYERS.items()],
        T.StructField("raw", T.BinaryType()),
        T.StructField("batch", T.StringType()),
        T.StructField("dt", T.DateType()),
        T.StructField("iface", T.StringType()),
    ]
)

LOGS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("sourceip", T.StringType()),
        T.StructField("sourcemac", T.StringType()),
        T.StructField("destinationip", T.StringType()),
        T.StructField("destinationmac", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("ipversion", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)
LOG_BODY = [f.name for f in LOGS if f.name not in ("id", "created_at")]

# Column limits of the log table.
LOG_MAX_LENGTH = {
    "sourceip": 200,
    "sourcemac": 2000,
    "destinationip": 200,
    "destinationmac": 2000,
    "protocol": 100,
    "ipversion": 100,
    "details": 2000,
}
LOG_NOT_NULL = ["sourceip", "destinationip", "protocol", "details"]

GEO = T.StructType(
    [
        T.StructField("country", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("regionName", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("isp", T.StringType()),
        T.StructField("org", T.StringType()),
        T.StructField("timezone", T.StringType()),
    ]
)
