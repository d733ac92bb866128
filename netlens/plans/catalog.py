"""One registered query per operator of the inventory.

Each takes ``(spark, sf_dir)`` and runs over whole tables.  Binary values are
shown as hex; nothing compared depends on the clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    ethernet_pad,
    ethernet_pad_hex,
    geo_fields,
    hex_stream,
    hex_to_bytes,
    printable,
    trusted_issuer,
)
from ..operators import bindings, certificates, filters, flood, logs, prefixes, rules, sessions, tcp, views
from ..operators.arp import arp_untrusted
from ..operators.decode import fields, protocol_name, resolve_ips
from ..operators.enrich import enrich_both_ends, enrich_ip
from ..operators.ids import assign_ids
from ..operators.keyed import append_status, insert_if_absent, key_exists
from ..schema import LOG_BODY
from ..session import scratch_dir, tune
from ..sources import (
    append_packets,
    clear_buffer,
    end_of,
    log_page,
    merge_date,
    packet_page,
    packets_since,
    read_buffer,
    read_captures,
    read_logs,
    scan_captures,
    stream_captures,
    write_table,
)
from ..streaming import Capture, alerts, stream_packets
from . import fixture
from .fixture import packets_raw, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        return fn

    return register


# Decode -----------------------------------------------------------------------


def _layer(name: str, layer: str, **shown: str) -> None:
    @query(name)
    def run(spark, sf_dir):
        df = filters.only_layer(packets_raw(spark, sf_dir), layer)
        return df.select("packet_id", *[F.expr(e).alias(name) for name, e in shown.items()])


_layer("decode_ethernet", "eth", eth_dst="eth_dst", eth_src="eth_src", eth_type="eth_type")
_layer("decode_llc", "llc", dsap="llc_dsap", ssap="llc_ssap", control="llc_control")
_layer("decode_ipv4", "ipv4", src="ipv4_src", dst="ipv4_dst", proto="ipv4_proto", ihl="ipv4_ihl")
_layer("decode_ipv6", "ipv6", src="ipv6_src", dst="ipv6_dst", next_header="ipv6_next_header")
_layer("decode_arp", "arp", spa="arp_spa", sha="arp_sha", tpa="arp_tpa", tha="arp_tha", op="arp_op")
_layer("decode_udp", "udp", src_port="udp_src_port", dst_port="udp_dst_port")
_layer(
    "decode_tcp",
    "tcp",
    src_port="tcp_src_port",
    dst_port="tcp_dst_port",
    syn="tcp_syn",
    ack="tcp_ack",
    fin="tcp_fin",
    psh="tcp_psh",
    payload_hex="coalesce(lower(hex(tcp_payload)), 'none')",
)


@query("decode_tagged")
def decode_tagged(spark, sf_dir):
    df = resolve_ips(fixture.packets_tagged(spark, sf_dir))
    shown = ["packet_id", "eth_type", "llc_control", "arp_spa", "arp_sha", "tcp_dst_port", "tcp_syn", "udp_dst_port"]
    return df.select(*shown, F.col("sourceIp").alias("src"), F.col("destinationIp").alias("dst"))


@query("anomalies_ip_tagged")
def anomalies_ip_tagged(spark, sf_dir):
    return rules.anomalies(fixture.packets_tagged(spark, sf_dir), "ip").select("packet_id")


@query("decode_ipv6_ext")
def decode_ipv6_ext(spark, sf_dir):
    df = filters.only_layer(fixture.packets_extended(spark, sf_dir), "ipv6")
    payload = F.coalesce(F.lower(F.hex("tcp_payload")), F.lit("none")).alias("payload_hex")
    return df.select("packet_id", "ipv6_next_header", "tcp_dst_port", "tcp_syn", "udp_dst_port", payload)


@query("long_frames")
def long_frames(spark, sf_dir):
    """Frames of more than 65,536 bytes are read and decoded whole."""
    df = fields(fixture.long_frames(spark, sf_dir))
    body = F.sha2("tcp_payload", 256).alias("payload_sha256")
    return df.select(F.col("packet_id").alias("doc_id"), "len", F.length("tcp_payload").alias("payload_bytes"), body)


@query("pcap_frames")
def pcap_frames(spark, sf_dir):
    """Frames written as capture files, read back in ranges and decoded."""
    df = fields(read_captures(spark, fixture.captures(spark, sf_dir), iface="eth0", split_bytes=500_000))
    return df.select("ts", "iface", "len", "arp_spa", "tcp_dst_port", F.lower(F.hex("raw")).alias("raw_hex"))


@query("pcap_source")
def pcap_source(spark, sf_dir):
    """The same files through ``format("pcap")``."""
    df = fields(scan_captures(spark, fixture.captures(spark, sf_dir), iface="eth0", split_bytes=500_000))
    return df.select("ts", "iface", "len", "arp_spa", "tcp_dst_port", F.lower(F.hex("raw")).alias("raw_hex"))


@query("decode_layers")
def decode_layers(spark, sf_dir):
    df = fields(packets_raw(spark, sf_dir))
    layers = ["eth", "llc", "ipv4", "ipv6", "arp", "tcp", "udp"]
    return df.select("packet_id", *[views.has_layer(x).alias(f"has_{x}") for x in layers])


@query("resolve_ips")
def resolve_addresses(spark, sf_dir):
    df = resolve_ips(packets_raw(spark, sf_dir))
    return df.select("packet_id", "sourceIp", "destinationIp")


@query("protocol_name")
def protocol_names(spark, sf_dir):
    return fields(packets_raw(spark, sf_dir)).select("packet_id", protocol_name().alias("protocol"))


@query("packet_length")
def packet_length(spark, sf_dir):
    return packets_raw(spark, sf_dir).select("packet_id", F.length("raw").alias("len"))


# Functions --------------------------------------------------------------------


def _bytes_query(name: str, **columns) -> None:
    def run(spark, sf_dir):
        raw = F.col("raw")
        return packets_raw(spark, sf_dir).select(
            "packet_id", *[make(raw).alias(column) for column, make in columns.items()]
        )

    query(name)(run)


_bytes_query("hex_stream", hex_stream=hex_stream)
_bytes_query(
    "hex_to_bytes", bytes_hex=lambda raw: F.lower(F.hex(hex_to_bytes(hex_stream(raw))))
)
_bytes_query(
    "ethernet_pad",
    pad_hex=lambda raw: F.lower(F.hex(ethernet_pad(raw))),
    pad_stream=ethernet_pad_hex,
)


@query("printable_documents")
def printable_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", printable(F.col("text").cast("binary")).alias("printable"))


@query("payload_text_pages")
def payload_text_pages(spark, sf_dir):
    df = views.readable_payload(fixture.page_frames(spark, sf_dir))
    return df.select(F.col("packet_id").alias("page_id"), "payload_text")


@query("payload_text_frames")
def payload_text_frames(spark, sf_dir):
    return views.readable_payload(packets_raw(spark, sf_dir)).select("packet_id", "payload_text")


# Views ------------------------------------------------------------------------


@query("packet_view")
def packet_view(spark, sf_dir):
    view = views.packet_view(packets_raw(spark, sf_dir), keep=["packet_id"])
    return view.select(
        "packet_id",
        F.col("ethernetHeader.destinationAddress").alias("destination_address"),
        F.col("ethernetHeader.sourceAddress").alias("source_address"),
        F.col("ethernetHeader.type").alias("type"),
        F.col("llcHeader.dsap").alias("dsap"),
        F.col("llcHeader.ssap").alias("ssap"),
        F.col("llcHeader.control").alias("control"),
        F.col("dataHexStream").alias("data_hex_stream"),
        F.col("ethernetPadHexStream").alias("ethernet_pad_hex_stream"),
        F.col("sourceIpAddress").alias("source_ip"),
        F.col("destinationIpAddress").alias("destination_ip"),
    )


@query("display_packets")
def display_packets(spark, sf_dir):
    view = views.packet_view(packets_raw(spark, sf_dir), keep=["packet_id"])
    return views.display_packets(view, keep=["packet_id"])


@query("count_records")
def count_records(spark, sf_dir):
    return views.count_records(views.packet_view(packets_raw(spark, sf_dir)))


@query("json_rows")
def json_rows(spark, sf_dir):
    return views.to_json_rows(views.packet_view(packets_raw(spark, sf_dir), keep=["packet_id"]))


# Filters ----------------------------------------------------------------------


@query("select_interface")
def select_interface(spark, sf_dir):
    df = fixture.packets_three_interfaces(spark, sf_dir)
    chosen = filters.select_interface(df, "eth1", fixture.interfaces(spark))
    return chosen.select("packet_id", "iface")


@query("list_interfaces")
def list_interfaces(spark, sf_dir):
    seen = fixture.packets_three_interfaces(spark, sf_dir).select(F.col("iface").alias("name"))
    known = fixture.interfaces(spark)
    return filters.list_interfaces(seen.join(F.broadcast(known), "name"))


@query("snaplen_96")
def snaplen_96(spark, sf_dir):
    df = fields(filters.truncate_snaplen(packets_raw(spark, sf_dir), 96))
    return df.select("packet_id", "len", rules.size_rule_ip().alias("size_ip"))


@query("host_filter")
def host_filter(spark, sf_dir):
    return filters.host_filter(packets_raw(spark, sf_dir), "10.0.1.2").select("packet_id")


@query("host_filter_arp")
def host_filter_arp(spark, sf_dir):
    return filters.host_filter(packets_raw(spark, sf_dir), "10.0.0.2").select("packet_id")


@query("host_filter_ipv6")
def host_filter_ipv6(spark, sf_dir):
    return filters.host_filter(packets_raw(spark, sf_dir), "2001:DB8::004").select("packet_id")


@query("host_set_filter")
def host_set_filter(spark, sf_dir):
    hosts = fixture.hosts(spark, sf_dir)
    return filters.host_set_filter(packets_raw(spark, sf_dir), hosts).select("packet_id")


@query("host_set_filter_shuffled")
def host_set_filter_shuffled(spark, sf_dir):
    hosts = fixture.hosts(spark, sf_dir)
    return filters.host_set_filter(packets_raw(spark, sf_dir), hosts, strategy="merge").select("packet_id")


@query("host_set_filter_ipv6")
def host_set_filter_ipv6(spark, sf_dir):
    hosts = fixture.hosts_ipv6(spark, sf_dir)
    return filters.host_set_filter(packets_raw(spark, sf_dir), hosts).select("packet_id")


# Rules ------------------------------------------------------------------------


def _rule_query(name: str, rule) -> None:
    def run(spark, sf_dir):
        return fields(packets_raw(spark, sf_dir)).select("packet_id", rule().alias("hit"))

    query(name)(run)


_rule_query("rule_size_base", rules.size_rule_base)
_rule_query("rule_size_ip", rules.size_rule_ip)
_rule_query("rule_small_ok", rules.valid_small_packet)
_rule_query("rule_proto_v4", rules.uncommon_protocol_v4)
_rule_query("rule_proto_v6", rules.uncommon_protocol_v6)
_rule_query("rule_syn_v4", rules.syn_only_v4)
_rule_query("rule_syn_v6", rules.syn_only_v6)
_rule_query("rule_certificate", rules.unusual_certificate)
_rule_query(
    "rule_certificate_hook",
    lambda: rules.unusual_certificate(lambda payload: payload.isNotNull()),
)


def _arp_query(mode: str) -> None:
    def run(spark, sf_dir):
        df = arp_untrusted(packets_raw(spark, sf_dir), mode=mode)
        return df.select("packet_id", F.col("arp_untrusted").alias("hit"))

    query(f"rule_arp_{mode}")(run)


for _mode in ("source", "all_arp", "corrected"):
    _arp_query(_mode)


def _set_queries(name: str) -> None:
    def anomalies(spark, sf_dir):
        return rules.anomalies(packets_raw(spark, sf_dir), name).select("packet_id")

    def first(spark, sf_dir):
        df = rules.flag(packets_raw(spark, sf_dir), name)
        return df.select("packet_id", F.coalesce("first_rule", F.lit("none")).alias("first_rule"))

    def records(spark, sf_dir):
        return views.log_records(packets_raw(spark, sf_dir), name, keep=["packet_id"])

    query(f"anomalies_{name}")(anomalies)
    query(f"first_rule_{name}")(first)
    query(f"log_records_{name}")(records)


_set_queries("base")
_set_queries("ip")


# Log table --------------------------------------------------------------------


@query("logs_valid")
def logs_valid(spark, sf_dir):
    rows = views.log_records(packets_raw(spark, sf_dir), "ip", keep=["packet_id"])
    return logs.validate_logs(rows)[0].select("packet_id", "sourceip", "destinationip", "protocol")


@query("logs_rejected")
def logs_rejected(spark, sf_dir):
    rows = views.log_records(packets_raw(spark, sf_dir), "ip", keep=["packet_id"])
    rejected = logs.validate_logs(rows)[1]
    return rejected.select("packet_id", F.array_join("violations", ", ").alias("violations"))


def base_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log table after one run of the base rules; ids in order of capture."""
    rows = views.log_records(packets_raw(spark, sf_dir), "base", keep=["packet_id"])
    numbered = assign_ids(rows, 0, ["timestamp", "packet_id"])
    return logs.with_defaults(numbered.drop("packet_id")).select(logs.LOG_COLUMNS)


SHOWN = [c for c in logs.LOG_COLUMNS if c != "created_at"]


@query("display_logs")
def display_logs(spark, sf_dir):
    return views.display_logs(base_logs(spark, sf_dir))


@query("log_get")
def log_get(spark, sf_dir):
    return logs.get_log(base_logs(spark, sf_dir), 7).select(SHOWN)


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log body per customer, as a caller would send it."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("seq"),
        F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("timestamp"),
        F.col("c_name").alias("sourceip"),
        F.lit(None).cast("string").alias("sourcemac"),
        F.col("c_mktsegment").alias("destinationip"),
        F.lit(None).cast("string").alias("destinationmac"),
        F.lit("HTTP").alias("protocol"),
        F.lit(None).cast("string").alias("ipversion"),
        F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("details"),
    )


def _last_id(rows: DataFrame) -> int:
    return rows.agg(F.max("id")).first()[0] or 0


@query("log_insert")
def log_insert(spark, sf_dir):
    current = base_logs(spark, sf_dir)
    valid, _ = logs.validate_logs(customer_rows(spark, sf_dir))
    new = logs.insert_logs(valid, _last_id(current), ["seq"])
    return current.unionByName(new).select(SHOWN)


def log_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One update per customer: own row, another row, a missing row, no id, unknown path."""
    seq, nation = F.col("seq"), F.regexp_extract("details", r"(\d+)", 1).cast("int")
    return customer_rows(spark, sf_dir).withColumns(
        {
            "path_id": F.when(nation == 3, F.lit(-1)).otherwise(seq),
            "id": F.when(nation == 4, F.lit(None).cast("long"))
            .when(nation == 5, seq + 2)
            .when(nation == 6, seq + 10_000_000)
            .otherwise(seq),
        }
    )


@query("log_upsert")
def log_upsert(spark, sf_dir):
    current = base_logs(spark, sf_dir)
    changed, _ = logs.upsert_logs(current, log_updates(spark, sf_dir), _last_id(current))
    return changed.select(SHOWN)


@query("upsert_rejected")
def upsert_rejected(spark, sf_dir):
    """Updates that break a column constraint come back and change nothing."""
    nation = F.regexp_extract("details", r"(\d+)", 1).cast("int")
    updates = log_updates(spark, sf_dir).withColumns(
        {
            "destinationip": F.when(nation != 7, F.col("destinationip")),
            "protocol": F.when(nation == 8, F.repeat("protocol", 26)).otherwise(F.col("protocol")),
        }
    )
    _, rejected = logs.upsert_logs(base_logs(spark, sf_dir), updates, 0)
    return rejected.select("seq", F.array_join("violations", ", ").alias("violations"))


@query("logs_too_long")
def logs_too_long(spark, sf_dir):
    """Documents as log details: those over the column's limit are rejected."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("lang").alias("sourceip"),
        F.col("source").alias("destinationip"),
        F.lit("HTTP").alias("protocol"),
        F.col("text").alias("details"),
    )
    rejected = logs.validate_logs(rows)[1]
    return rejected.select("doc_id", F.array_join("violations", ", ").alias("violations"))


def deleted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to delete, some of them unknown."""
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3 - 6).alias("id"))


@query("log_delete")
def log_delete(spark, sf_dir):
    return logs.delete_logs(base_logs(spark, sf_dir), deleted_ids(spark, sf_dir)).select(SHOWN)


@query("log_table")
def log_table(spark, sf_dir):
    """The table stored, then a batch of updates and one of deletes, each result in a new folder."""
    path = scratch_dir(spark, "log-table")
    write_table(base_logs(spark, sf_dir), f"{path}/first")
    first = read_logs(spark, f"{path}/first")
    write_table(logs.upsert_logs(first, log_updates(spark, sf_dir), _last_id(first))[0], f"{path}/second")
    write_table(logs.delete_logs(read_logs(spark, f"{path}/second"), deleted_ids(spark, sf_dir)), f"{path}/third")
    return read_logs(spark, f"{path}/third").select(SHOWN)


# Keyed append -----------------------------------------------------------------


def _accounts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as the keyed table, orders as the batch: repeated, known, new, null keys."""
    target = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_custkey").alias("seq")
    )
    batch = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") * 2).alias("key"),
        F.col("o_orderkey").alias("seq"),
    )
    return target, batch


@query("insert_if_absent")
def insert_if_absent_rows(spark, sf_dir):
    kept, _ = insert_if_absent(*_accounts(spark, sf_dir), "key", "seq")
    return kept.select(F.coalesce(F.col("key"), F.lit(-1)).alias("key"), "seq")


@query("insert_refused")
def insert_refused(spark, sf_dir):
    status = append_status(*_accounts(spark, sf_dir), "key", "seq")
    return status.filter(~F.col("accepted")).select("key", "seq")


@query("key_exists")
def key_exists_rows(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    flagged = key_exists(customer, orders, "c_custkey", "o_custkey", "c_custkey")
    return flagged.select("c_custkey", "exists")


@query("key_exists_shuffled")
def key_exists_shuffled(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    flagged = key_exists(customer, orders, "c_custkey", "o_custkey", "c_custkey", strategy="merge")
    return flagged.select("c_custkey", "exists")


# Enrichment -------------------------------------------------------------------


def _shown_info(prefix: str = "") -> list:
    geo = f"{prefix}geoData"
    return [
        f"{prefix}domainName",
        f"{prefix}whoisData",
        F.col(f"{geo}.country").alias(f"{prefix}country"),
        F.col(f"{geo}.regionName").alias(f"{prefix}region_name"),
        f"{prefix}status",
    ]


@query("enrich_ip")
def enrich_addresses(spark, sf_dir):
    df = resolve_ips(packets_raw(spark, sf_dir))
    rich = enrich_ip(df, "sourceIp", fixture.lookups(spark, sf_dir))
    return rich.select("packet_id", F.col("sourceIp").alias("ip_address"), *_shown_info())


@query("enrich_both_ends")
def enrich_ends(spark, sf_dir):
    rows = views.log_records(packets_raw(spark, sf_dir), "base", keep=["packet_id"])
    rich = enrich_both_ends(rows, fixture.lookups(spark, sf_dir), spread_by="packet_id")
    return rich.select(
        "packet_id", "sourceip", "destinationip", *_shown_info("src_"), *_shown_info("dst_")
    )


@query("enrich_both_ends_shuffled")
def enrich_ends_shuffled(spark, sf_dir):
    rows = views.log_records(packets_raw(spark, sf_dir), "base", keep=["packet_id"])
    rich = enrich_both_ends(rows, fixture.lookups(spark, sf_dir), spread_by="packet_id", strategy="merge")
    return rich.select(
        "packet_id", "sourceip", "destinationip", *_shown_info("src_"), *_shown_info("dst_")
    )


@query("match_prefixes")
def match_networks(spark, sf_dir):
    """The longest of nested networks that a source address lies in."""
    df = resolve_ips(packets_raw(spark, sf_dir))
    found = prefixes.match_prefixes(df, "sourceIp", fixture.networks(spark, sf_dir), ["label"])
    return found.select("packet_id", F.col("sourceIp").alias("ip_address"), "label")


@query("match_ranges")
def match_ranges(spark, sf_dir):
    """Networks given as ranges of addresses."""
    nets = prefixes.ranges_to_prefixes(fixture.address_ranges(spark, sf_dir))
    found = prefixes.match_prefixes(resolve_ips(packets_raw(spark, sf_dir)), "sourceIp", nets, ["label"])
    return found.where("label is not null").select("packet_id", "label")


@query("geo_fields")
def geo_answers(spark, sf_dir):
    geo = fixture.lookups(spark, sf_dir).geo.withColumn("g", geo_fields(F.col("geo_json")))
    names = ["country", "city", "regionName", "lat", "lon", "isp", "org", "timezone"]
    return geo.select("ip", *[F.col(f"g.{n}").alias(n) for n in names])


@query("trusted_issuer")
def trusted_issuers(spark, sf_dir):
    issuer = F.concat(F.lit("TrustedCA"), F.col("c_nationkey").cast("string"))
    customer = table(spark, sf_dir, "customer").withColumn("issuer", issuer)
    return customer.select("c_custkey", "issuer", trusted_issuer(F.col("issuer")).alias("trusted"))


# Streaming --------------------------------------------------------------------


@query("stream_detect")
def stream_detect(spark, sf_dir):
    """Frames landed as files, captured to the end, and the log rows they gave."""
    out = scratch_dir(spark, "capture")
    packets_raw(spark, sf_dir).write.parquet(f"{out}/landing")
    capture = Capture(spark, f"detect-{out[-8:]}", out)
    capture.start(stream_packets(spark, f"{out}/landing"), available_now=True).awaitTermination()
    return capture.logs().select(LOG_BODY)


#: Windows of the SYN rates: wide, as the events lie minutes apart.
RATE = {"window": "2 hours", "slide": "1 hour", "least": 5}


@query("syn_half_open")
def syn_half_open(spark, sf_dir):
    return flood.half_open(fixture.connection_frames(spark, sf_dir))


@query("syn_rates")
def syn_rates(spark, sf_dir):
    return flood.syn_rates(fixture.connection_frames(spark, sf_dir), **RATE)


@query("stream_syn_rates")
def stream_rates(spark, sf_dir):
    """The same rates from a stream of the frames."""
    return _streamed(spark, fixture.connection_frames(spark, sf_dir), "syn-rates", lambda packets: alerts.stream_syn_rates(packets, **RATE))


@query("flow_sessions")
def flow_sessions(spark, sf_dir):
    """Sessions of flows in both directions; pauses of hours, as the events lie minutes apart."""
    return sessions.sessions(fixture.chat_frames(spark, sf_dir), idle=12 * 3_600, width=6 * 3_600)


@query("mac_history")
def mac_history(spark, sf_dir):
    return bindings.mac_history(fixture.claim_frames(spark, sf_dir))


@query("mac_in_force")
def mac_in_force(spark, sf_dir):
    """The binding of every packet's source address at its time."""
    found = bindings.mac_in_force(fixture.claim_frames(spark, sf_dir))
    return found.where("ipv4_src is not null").select("packet_id", "ipv4_src", "bound_mac", "bound_since", "mac_differs")


@query("stream_mac_changes")
def stream_changes(spark, sf_dir):
    """The changes of bindings from a stream of the frames."""
    alerts.use_rocksdb(spark)
    return _streamed(spark, fixture.claim_frames(spark, sf_dir), "mac-changes", alerts.stream_mac_changes, "packet_id % 2 = 1")


def _streamed(spark: SparkSession, frames: DataFrame, purpose: str, make: Callable[[DataFrame], DataFrame], last: str = "true") -> DataFrame:
    """What a stream appends while frames land in three lots, one after another in time; it is
    started again for each. A frame (one with ``last``) that is days later closes what still waits."""
    out, at = scratch_dir(spark, purpose), F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = frames.select(F.percentile_approx(at, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q")).first()["q"]
    lot = F.lit(0)
    for bound in bounds:
        lot = lot + (at >= bound).cast("int")
    lots = [frames.where(lot == i) for i in range(3)]
    lots.append(frames.where(last).orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.lit(30))))
    for part in lots:
        part.write.mode("append").parquet(f"{out}/landing")
        rows = make(stream_packets(spark, f"{out}/landing"))
        writer = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/rows")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


@query("tcp_streams")
def tcp_streams(spark, sf_dir):
    """Documents put together again from their segments."""
    parts = tcp.streams(fixture.document_streams(spark, sf_dir)).groupBy("src_ip", "connection")
    whole = parts.agg(F.array_sort(F.collect_list(F.struct("offset", "data"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), "")
    return whole.select("src_ip", "connection", (F.length(joined) / 2).cast("long").alias("n_bytes"), F.sha2(F.unhex(joined), 256).alias("sha256"))


@query("tls_certificates")
def tls_certificates(spark, sf_dir):
    found = certificates.judged_certificates(fixture.handshakes(spark, sf_dir))
    shown = ["src_ip", "dst_port", "issuer", "issuer_cn", "subject", "serial", "not_before", "not_after", "chain", "shown_at"]
    return found.select(*shown, F.array_join("reasons", ",").alias("reasons"))


@query("rule_certificate_flow")
def rule_certificate_flow(spark, sf_dir):
    """The certificate rule over whole handshakes: the packets of flows with a bad certificate."""
    marked = certificates.with_certificates(fixture.handshakes(spark, sf_dir))
    own = [("certificate", lambda: F.col("certificate_reasons").isNotNull())]
    return rules.anomalies(marked, own).select("packet_id", F.array_join("certificate_reasons", ",").alias("reasons"))


@query("stream_captures")
def stream_capture_files(spark, sf_dir):
    """A folder of capture files followed by a stream, and the log rows it gave."""
    out = scratch_dir(spark, "capture-files")
    landed = fixture.captures(spark, sf_dir)
    capture = Capture(spark, f"captures-{out[-8:]}", out)
    source = stream_captures(spark, landed, f"{out}/source", iface="eth0", split_bytes=500_000)
    capture.start(source, available_now=True).awaitTermination()
    return capture.logs().select(LOG_BODY)


@query("stream_two_captures")
def stream_two_captures(spark, sf_dir):
    """Both rule sets capture the same frames at once into one log folder."""
    out = scratch_dir(spark, "two-captures")
    # as many files, and so batches, whatever their size
    packets_raw(spark, sf_dir).coalesce(spark.sparkContext.defaultParallelism).write.parquet(f"{out}/landing")
    both = [Capture(spark, f"{r}-{out[-8:]}", f"{out}/{r}", rules=r, logs=f"{out}/logs") for r in ("base", "ip")]
    running = [c.start(stream_packets(spark, f"{out}/landing", max_files=3), available_now=True) for c in both]
    for query_ in running:
        query_.awaitTermination()
    return both[0].logs().select(LOG_BODY)


@query("stream_restart")
def stream_restart(spark, sf_dir):
    """A capture that ends, and goes on after more files arrived: nothing lost, nothing twice."""
    out = scratch_dir(spark, "restart")
    frames = packets_raw(spark, sf_dir)
    capture = Capture(spark, f"restart-{out[-8:]}", out, rules="ip")
    for part in (frames.filter("packet_id % 2 = 0"), frames.filter("packet_id % 2 = 1")):
        part.write.mode("append").parquet(f"{out}/landing")
        capture.start(stream_packets(spark, f"{out}/landing"), available_now=True).awaitTermination()
        capture.stop()
    return capture.logs().select(LOG_BODY)


@query("stream_snapshot")
def stream_snapshot(spark, sf_dir):
    """All packets captured so far, asked while the capture runs and after it was stopped."""
    out = scratch_dir(spark, "snapshot")
    packets_raw(spark, sf_dir).write.parquet(f"{out}/landing")
    capture = Capture(spark, f"snapshot-{out[-8:]}", out)
    running = capture.start(stream_packets(spark, f"{out}/landing"), every="0 seconds")
    running.processAllAvailable()
    seen = capture.packets().count()
    capture.stop()
    return capture.packets().select("packet_id", "len", "src_ip", F.lit(seen).alias("seen_running"))


@query("buffer_clear")
def buffer_clear(spark, sf_dir):
    """Frames appended, cleared away, appended again and merged by date: each is there once."""
    out = scratch_dir(spark, "cleared")
    append_packets(packets_raw(spark, sf_dir), out)
    clear_buffer(spark, out)
    left = read_buffer(spark, out).count()
    append_packets(packets_raw(spark, sf_dir), out, batch="again")
    append_packets(packets_raw(spark, sf_dir), out, batch="again")
    for row in read_buffer(spark, out).select("dt").distinct().collect():  # the dates of a buffer, one merge each
        merge_date(spark, out, row["dt"])
    return read_buffer(spark, out).select("packet_id", "len", "src_ip", F.lit(left).alias("left"))


@query("packet_page")
def third_page(spark, sf_dir):
    """The third page of 300 packets, each begun behind the one before."""
    out = scratch_dir(spark, "paged")
    append_packets(packets_raw(spark, sf_dir), out)
    cursor = None
    for _ in range(2):
        cursor = end_of(packet_page(spark, out, cursor, 300))
    return packet_page(spark, out, cursor, 300).select("packet_id", "ts", "len", "src_ip")


@query("log_page")
def second_log_page(spark, sf_dir):
    """The second page of 200 log rows."""
    path = scratch_dir(spark, "log-page")
    write_table(base_logs(spark, sf_dir), path)
    last = log_page(spark, path, 0, 200).agg(F.max("id")).first()[0]
    return log_page(spark, path, last, 200).select(SHOWN)


@query("stream_new_packets")
def stream_new_packets(spark, sf_dir):
    """A capture looked at after its first batch: later looks read what is new."""
    out = scratch_dir(spark, "new-packets")
    frames = packets_raw(spark, sf_dir)
    capture = Capture(spark, f"new-{out[-8:]}", out)
    for part in (frames.filter("packet_id % 2 = 0"), frames.filter("packet_id % 2 = 1")):
        part.write.mode("append").parquet(f"{out}/landing")
        running = capture.start(stream_packets(spark, f"{out}/landing"), available_now=True)
        running.awaitTermination()
    return packets_since(spark, f"{out}/packets", str(running.id), 0).select("packet_id", "len", "src_ip")


@query("packet_buffer")
def packet_buffer(spark, sf_dir):
    """Frames through the stored form: append, then read header columns back."""
    out = scratch_dir(spark, "buffer")
    append_packets(packets_raw(spark, sf_dir), out)
    stored = read_buffer(spark, out)
    return stored.select("packet_id", "len", "src_ip", "dst_ip", "iface", F.hex("raw").alias("raw_hex"))
