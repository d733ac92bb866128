"""Test inputs derived by Spark from the driver tables.

``packets_raw`` has one Ethernet frame per event, built by integer arithmetic
and hex text only, so that a second SQL engine can build the same frames.  The
same SQL text serves both engines but for integer division (``//`` / ``div``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.enrich import Lookups
from ..session import scratch_dir
from ..sources.packets import read_packets
from ..sources.pcap import write_captures

# Field values of each frame (CTE k) and the frame as hex text (CTE frames).
FRAMES_SQL = """
with b as (
  select event_id as packet_id, ts, user_id,
    case when event_id % 20 = 0 then 'arp' when event_id % 20 = 1 then 'llc'
         when event_id % 20 < 6 then 'ipv6' else 'ipv4' end as kind,
    case event_id % 11
      when 0 then (case when event_id % 20 between 2 and 5 then 58 else 1 end)
      when 1 then 47 when 2 then 17 when 3 then 17 else 6 end as ip_proto,
    case event_id % 13 when 0 then 2 when 1 then 18 when 2 then 16
      when 3 then 24 when 4 then 17 else 16 end as tcp_flags,
    1024 + event_id % 50000 as src_port,
    case event_id % 17 when 0 then 443 when 1 then 80 when 2 then 53 else 8080 end as dst_port,
    case event_id % 7 when 0 then 54 when 1 then 60 when 2 then 62 when 3 then 64
      when 4 then 1500 when 5 then 1501 else 200 + event_id % 900 end as want_len,
    case when event_id % 17 = 1 then 'GET / HTTP/1.1'
      else concat(event_type, ' ', props) end as body
  from events),
c as (
  select *, lpad(hex(user_id % 250 + 1), 2, '0') as u, lpad(hex(packet_id % 200 + 1), 2, '0') as d,
    case when want_len <= 64 then '' else hex(body) end as body_hex,
    case ip_proto
      when 6 then concat(lpad(hex(src_port), 4, '0'), lpad(hex(dst_port), 4, '0'),
        '0000000100000000', '50', lpad(hex(tcp_flags), 2, '0'), 'FFFF00000000')
      when 17 then concat(lpad(hex(src_port), 4, '0'), lpad(hex(dst_port), 4, '0'), '00080000')
      else '' end as l4
  from b),
h as (
  select *, concat('02000000C8', d, '0200000000', u) as macs,
    concat('0A00', lpad(hex(user_id % 4), 2, '0'), u) as v4s, concat('C0A801', d) as v4d,
    case packet_id % 120 when 0 then '0011223344550A000001' when 20 then '0200000000EE0A000001'
      when 40 then '66778899AABB0A000002' when 60 then '0200000000EE0A000002'
      else concat('0200000000', u, '0A000009') end as arp_sender
  from c),
f as (
  select *, case kind
    when 'ipv4' then concat(macs, '0800', '4500',
      lpad(hex(20 + length(l4) // 2 + length(body_hex) // 2), 4, '0'), '0000400040',
      lpad(hex(ip_proto), 2, '0'), '0000', v4s, v4d, l4, body_hex)
    when 'ipv6' then concat(macs, '86DD', '60000000',
      lpad(hex(length(l4) // 2 + length(body_hex) // 2), 4, '0'), lpad(hex(ip_proto), 2, '0'), '40',
      '20010DB80000000000000000000000', u, '20010DB80000000000010000000000', d, l4, body_hex)
    when 'arp' then concat(macs, '0806', '0001080006040001', arp_sender, '000000000000', v4d)
    else concat(macs, '0026', '424203', repeat('00', 35)) end as head
  from h),
frames as (
  select *, rpad(head, cast(greatest(length(head), want_len * 2) as int), 'A5') as raw_hex from f)
"""

# Every third frame has one tag, every third two: CTE tagged, after frames.
TAGGED_SQL = """,
tags as (
  select *, case packet_id % 3 when 1 then '81000064' when 2 then '88A8006481000065' else '' end as tag from frames),
tagged as (select *, concat(left(raw_hex, 24), tag, substring(raw_hex, 25)) as tagged_hex from tags)
"""

# IPv6 frames with no, one or three extension headers, or as a later fragment: CTE extended.
EXTENDED_SQL = """,
chains as (
  select *, case when kind = 'ipv6' then packet_id % 4 else 0 end as chain, lpad(hex(ip_proto), 2, '0') as proto_hex,
    length(l4) // 2 + length(body_hex) // 2 as payload_bytes from frames),
headers as (
  select *, case chain when 1 then concat(proto_hex, '00010400000000')
    when 2 then concat('3C00010400000000', '2C01010C', repeat('00', 12), proto_hex, '00000000000001')
    when 3 then concat('2C00010400000000', proto_hex, '00000800000001') else '' end as ext from chains),
extended as (
  select *, case when chain = 0 then raw_hex else concat(left(raw_hex, 36),
    lpad(hex(payload_bytes + length(ext) // 2), 4, '0'), '00', substring(raw_hex, 43, 66), ext, substring(raw_hex, 109))
    end as extended_hex from headers)
"""

# Connections: a SYN of every event, its SYN-ACK, and an ACK in time, late (fifth of them) or never (another fifth).
# One destination has a third of all.  CTE steps, with the field values, and the frame as hex text.
STEPS_SQL = """
with e as (
  select event_id, ts, user_id, case when event_id % 3 = 0 then 1 else user_id % 40 + 2 end as dn,
    1024 + event_id % 50000 as client_port from events),
a as (
  select event_id * 4 as packet_id, ts, 2 as flags, e.* exclude (ts) from e
  union all select event_id * 4 + 1, ts + interval '1' second, 18, e.* exclude (ts) from e
  union all select event_id * 4 + 2, ts + interval '2' second, 16, e.* exclude (ts) from e where event_id % 5 > 1
  union all select event_id * 4 + 3, ts + interval '45' second, 24, e.* exclude (ts) from e where event_id % 5 <> 1),
steps as (
  select *, lpad(hex(user_id % 250 + 1), 2, '0') as u, lpad(hex(dn), 2, '0') as d, lpad(hex(user_id % 4), 2, '0') as n,
    case flags when 18 then 443 else client_port end as src_port, case flags when 18 then client_port else 443 end as dst_port
  from a)
"""
STEP_FRAME = """concat('02000000C8', d, '0200000000', u, '0800', '45000028', '0000400040060000',
  case flags when 18 then concat('C0A801', d, '0A00', n, u) else concat('0A00', n, u, 'C0A801', d) end,
  lpad(hex(src_port), 4, '0'), lpad(hex(dst_port), 4, '0'), '0000000100000000', '50', lpad(hex(flags), 2, '0'), 'FFFF00000000')"""

# Packets of a few flows, in both directions, with SYN, FIN and RST between; one flow has a third of all.
CHATS_SQL = """
with chats as (
  select event_id as packet_id, ts, case when event_id % 3 = 0 then 1 else user_id % 40 + 2 end as client,
    case when event_id % 3 = 0 then 1000 else 1000 + user_id % 3 end as port, event_id // 3 % 2 as reply,
    case event_id // 3 % 13 when 0 then 2 when 4 then 17 when 7 then 4 when 8 then 18 else 16 end as flags, event_id % 5 = 4 as is_udp
  from events)
"""
CHAT_FRAME = """concat('02000000C801', '020000000001', '0800', '45000028', '0000400040', case when is_udp then '11' else '06' end, '0000',
  case when reply = 1 then concat('C0A80101', '0A0000', lpad(hex(client), 2, '0')) else concat('0A0000', lpad(hex(client), 2, '0'), 'C0A80101') end,
  case when reply = 1 then concat('01BB', lpad(hex(port), 4, '0')) else concat(lpad(hex(port), 4, '0'), '01BB') end,
  case when is_udp then '00080000' else concat('0000000100000000', '50', lpad(hex(flags), 2, '0'), 'FFFF00000000') end)"""

# ARP announcements: the address of an event's user, or (every third) one hot address; the MAC moves with time.
ARP_SQL = """
with claims as (
  select event_id * 2 + 1 as packet_id, ts,
    case when event_id % 3 = 0 then 0 else user_id % 4 end as net, case when event_id % 3 = 0 then 1 else user_id % 250 + 1 end as octet,
    (user_id % 2 + event_id // 700) % 256 as mac from events)
"""
ARP_FRAME = """concat('FFFFFFFFFFFF', '0200000000', lpad(hex(mac), 2, '0'), '0806', '0001080006040001',
  '0200000000', lpad(hex(mac), 2, '0'), '0A00', lpad(hex(net), 2, '0'), lpad(hex(octet), 2, '0'), '000000000000', 'C0A80101')"""

# Hosts in several spellings of IPv6, and as upper-case text.
HOSTS_IPV6_SQL = """
select concat('2001:DB8::', upper(hex(s_suppkey))) as ip from supplier
union select concat('2001:0db8:0000:0000:0001::0', lower(hex(n_nationkey + 16))) from nation
"""

HOSTS_SQL = """
select concat('10.0.', cast(s_suppkey % 4 as string), '.', cast(s_suppkey as string)) as ip from supplier
union select concat('192.168.1.', cast(n_nationkey as string)) from nation
"""

# Networks of several sizes, one inside another, and of both kinds: label and prefix.
NETWORKS_SQL = """
select 'all' as label, '10.0.0.0/8' as prefix
union all select concat('net ', cast(n_nationkey % 4 as string)), concat('10.0.', cast(n_nationkey % 4 as string), '.0/24') from nation where n_nationkey < 4
union all select concat('part ', cast(n_nationkey as string)), concat('10.0.', cast(n_nationkey % 4 as string), '.', cast(n_nationkey * 8 as string), '/',
  cast(26 + n_nationkey % 5 as string)) from nation
union all select 'docs', '2001:DB8::/32'
union all select concat('six ', cast(n_nationkey as string)), concat('2001:db8::', lower(hex(n_nationkey * 16)), '/124') from nation where n_nationkey < 12
"""

# Ranges of addresses, both ends included: label, first and last.
RANGES_SQL = """
select concat('range ', cast(n_nationkey as string)) as label, concat('10.0.', cast(n_nationkey % 4 as string), '.', cast(n_nationkey * 9 + 1 as string)) as first,
  concat('10.0.', cast(n_nationkey % 4 as string), '.', cast(n_nationkey * 9 + 9 + n_nationkey % 3 as string)) as last from nation
"""

# Every source address with its last octet.
SOURCES_SQL = """
select distinct kind,
  case kind when 'ipv4' then concat('10.0.', cast(user_id % 4 as string), '.', cast(user_id % 250 + 1 as string))
    else concat('2001:db8:0:0:0:0:0:', lower(hex(user_id % 250 + 1))) end as ip,
  cast(user_id % 250 + 1 as int) as octet
from b where kind in ('ipv4', 'ipv6')
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table (a single file) dealt out to all cores, before larger rows are built of it."""
    return table(spark, sf_dir, name).repartition(spark.sparkContext.defaultParallelism)


def spark_sql(spark: SparkSession, sf_dir: str, text: str, *names: str, read=table) -> DataFrame:
    """Run SQL over driver tables, without registering views."""
    frames = {name: read(spark, sf_dir, name) for name in names}
    for name in names:
        text = text.replace(f"from {name}", f"from {{{name}}}")
    return spark.sql(text, **frames)


def build_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = FRAMES_SQL.replace("//", "div") + (
        "select packet_id, ts, 'eth0' as iface, unhex(raw_hex) as raw from frames"
    )
    return spark_sql(spark, sf_dir, text, "events", read=spread)


def _variant(text: str, column: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        select = f"select packet_id, ts, 'eth0' as iface, unhex({column}_hex) as raw from {column}"
        return spark_sql(spark, sf_dir, (FRAMES_SQL.rstrip() + text + select).replace("//", "div"), "events", read=spread)

    return build


def _written(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    """Folder of a derived table, written once per application and input; a capture lies in many files."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _FOLDERS:
        folder = scratch_dir(spark, name)
        build(spark, sf_dir).write.option("compression", "zstd").parquet(folder)
        _FOLDERS[key] = folder
    return _FOLDERS[key]


_FOLDERS: dict[tuple[str, str, str], str] = {}


def packets_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames as a capture lies on disk: parquet with ``raw BINARY``."""
    return read_packets(spark, _written(spark, sf_dir, "packets-raw", build_frames))


def packets_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_packets(spark, _written(spark, sf_dir, "packets-tagged", _variant(TAGGED_SQL, "tagged")))


def packets_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_packets(spark, _written(spark, sf_dir, "packets-extended", _variant(EXTENDED_SQL, "extended")))


def build_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = STEPS_SQL.replace("e.* exclude (ts)", "event_id, user_id, dn, client_port")
    return spark_sql(spark, sf_dir, f"{text} select packet_id, ts, 'eth0' as iface, unhex({STEP_FRAME}) as raw from steps", "events", read=spread)


def connection_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TCP connections, most of them answered, some half-open."""
    return read_packets(spark, _written(spark, sf_dir, "connections", build_steps))


def build_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = CHATS_SQL.replace("//", "div")
    return spark_sql(spark, sf_dir, f"{text} select packet_id, ts, 'eth0' as iface, unhex({CHAT_FRAME}) as raw from chats", "events", read=spread)


def chat_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_packets(spark, _written(spark, sf_dir, "chats", build_chats))


def build_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = ARP_SQL.replace("//", "div")
    claims = spark_sql(spark, sf_dir, f"{text} select packet_id, ts, 'eth0' as iface, unhex({ARP_FRAME}) as raw from claims", "events", read=spread)
    data = build_frames(spark, sf_dir).where("packet_id % 20 <> 0").withColumn("packet_id", F.col("packet_id") * 2)  # no ARP frames
    return claims.unionByName(data.withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.lit(1))))


def claim_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARP claims of addresses, and a second after each event its frame."""
    return read_packets(spark, _written(spark, sf_dir, "claims", build_claims))


def _tcp_frame(server: Column, seq: Column, flags: Column, payload: Column, server_port: str, client_port: Column) -> Column:
    """A frame from ``10.<server, three bytes>`` to 192.168.1.1."""
    wide = lambda value, digits: F.lpad(F.hex(value), digits, "0")
    head = [F.lit("02000000C80102000000000108004500"), wide(F.length(payload) + 40, 4), F.lit("00004000400600000A"), wide(server % 16777216, 6), F.lit("C0A80101")]
    tcp = [F.lit(server_port), wide(client_port, 4), wide(F.pmod(seq, F.lit(1 << 32)), 8), F.lit("0000000050"), flags, F.lit("FFFF00000000")]
    return F.concat(F.unhex(F.concat(*head, *tcp)), payload)


#: Number of a stream's first byte, less one: some wrap within the stream.
def _first_seq(key: Column) -> Column:
    return F.when(key % 4 == 0, F.lit((1 << 32) - 700)).otherwise(key * 7919)


def _at(key: Column, order: Column) -> Column:
    return (F.timestamp_millis(F.lit(1_709_251_200_000) + key * 60_000 + order)).cast("timestamp_ntz")


def build_document_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as TCP payloads of 1,000 bytes, out of order, every fifth one twice; every second stream with its SYN."""
    docs = spread(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text"))
    number = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 1000).cast("int"))
    parts = docs.where("length(text) > 0").select("doc_id", "text", F.explode(number).alias("i"))
    parts = parts.select("doc_id", F.col("i").cast("long").alias("i"), F.substring("text", F.col("i") * 1000 + 1, F.lit(1000)).alias("part"))
    again = parts.where("i % 5 = 0").withColumn("late", F.lit(5_000))
    opening = docs.where("doc_id % 2 = 0").select("doc_id", F.lit(-1).cast("long").alias("i"), F.lit(b"").alias("part"), F.lit(0).alias("late"))
    every = parts.withColumn("late", F.lit(0)).unionByName(again).unionByName(opening)
    seq = _first_seq(F.col("doc_id")) + F.when(F.col("i") >= 0, F.col("i") * 1000 + 1).otherwise(0)
    order = F.when(F.col("i") < 0, 0).otherwise(F.col("i") * 7919 % 1009 + 1 + F.col("late"))
    flags = F.when(F.col("i") < 0, F.lit("12")).otherwise(F.lit("18"))
    return every.select(
        (F.col("doc_id") * 1_000_000 + (F.col("i") + 1) * 10 + F.col("late") / 5_000).cast("long").alias("packet_id"),
        _at(F.col("doc_id"), order).alias("ts"),
        F.lit("eth0").alias("iface"),
        _tcp_frame(F.col("doc_id"), seq, flags, F.col("part"), "0050", F.lit(2000)).alias("raw"),
    )


def document_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_packets(spark, _written(spark, sf_dir, "document-streams", build_document_streams))


def _octets(text: str) -> Column:
    return F.lit(bytes.fromhex(text))


def _sized(value: Column, digits: int) -> Column:
    """Length of a value, as so many hex digits in bytes."""
    return F.unhex(F.lpad(F.hex(F.length(value)), digits, "0"))


def _tlv(tag: str, *content: Column) -> Column:
    """A DER element; its content is computed once, however deep elements are nested."""
    size = lambda body: F.when(F.length(body) < 128, _sized(body, 2)).otherwise(F.concat(_octets("82"), _sized(body, 4)))
    return F.transform(F.array(F.concat(*content)), lambda body: F.concat(_octets(tag), size(body), body))[0]


def _common_name(name: Column) -> Column:
    one = lambda oid, text: _tlv("31", _tlv("30", _octets(f"0603{oid}"), _tlv("0C", text)))
    return _tlv("30", one("55040A", F.lit(b"Example")), one("550403", name.cast("binary")))


def build_handshakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TLS server for each customer: its certificate in segments that overlap, come out of order and twice."""
    text = lambda value: F.lit(value.encode())
    sized = lambda value: F.concat(_sized(value, 6), value)
    key = F.col("c_custkey")
    rows = spread(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat(F.lit("TrustedCA"), F.col("c_nationkey").cast("string")).alias("ca"))
    rows = rows.withColumns(
        {
            "issuer": _common_name(F.when(key % 11 == 0, F.col("c_name")).otherwise(F.col("ca"))),
            "subject": _common_name(F.col("c_name")),
            "begin": _tlv("17", F.when(key % 7 == 0, text("250101000000Z")).otherwise(text("230101000000Z"))),
            "end": F.when(key % 5 == 0, _tlv("17", text("231231235959Z"))).otherwise(_tlv("18", text("20511231235959Z"))),
        }
    )
    rows = rows.withColumn("validity", _tlv("30", F.col("begin"), F.col("end")))
    algorithm, bits = _octets("300D06092A864886F70D01010B0500"), lambda n: _octets("0382" + f"{n:04X}" + "00" * n)
    serial = _tlv("02", _octets("01"), F.unhex(F.lpad(F.hex(key), 8, "0")))
    rows = rows.withColumn("signed", _tlv("30", _octets("A003020102"), serial, algorithm, F.col("issuer"), F.col("validity"), F.col("subject"), bits(400)))
    rows = rows.withColumn("certificate", _tlv("30", F.col("signed"), algorithm, bits(257)))
    rows = rows.withColumn("certificates", F.concat(sized(F.col("certificate")), sized(F.col("certificate"))))
    rows = rows.withColumn("listed", sized(F.col("certificates"))).withColumn("message", F.concat(_octets("0B"), sized(F.col("listed"))))
    record = lambda value: F.concat(_octets("160303"), _sized(value, 4), value)
    hello = _octets("02000046" + "00" * 70)
    halves = [F.substring("message", 1, 500), F.substring("message", F.lit(501), F.length("message"))]
    rows = rows.withColumn("stream", F.concat(record(hello), *map(record, halves), _octets("16030300040E000000" + "1703030010" + "AB" * 16)))
    third = (F.length("stream") / 3).cast("int")
    cut = lambda low, high: F.substring("stream", low + 1, high - low)
    segment = lambda order, at, part, flags="18": F.struct(F.lit(order).alias("order"), at.cast("long").alias("at"), part.alias("part"), F.lit(flags).alias("flags"))
    zero, size = F.lit(0), F.length("stream")
    sent = [
        segment(0, F.lit(-1), F.lit(b""), "12"),
        segment(1, third, cut(third, third * 2)),
        segment(2, zero, cut(zero, third)),
        segment(3, zero, cut(zero, third)),
        segment(4, third * 2 - 50, F.concat(_octets("FF" * 50), cut(third * 2, size))),
    ]
    rows = rows.select("c_custkey", F.explode(F.array(*sent)).alias("s")).select("c_custkey", "s.*")
    client = F.lit(1024) + key % 50000
    return rows.select(
        (key * 10 + F.col("order")).alias("packet_id"),
        _at(key % 1000, F.col("order")).alias("ts"),
        F.lit("eth0").alias("iface"),
        _tcp_frame(key, _first_seq(key) + F.col("at") + 1, F.col("flags"), F.col("part"), "01BB", client).alias("raw"),
    )


def handshakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_packets(spark, _written(spark, sf_dir, "handshakes", build_handshakes))


def build_long_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, repeated to over 65,536 bytes, as an IPv4 TCP payload (total length 0)."""
    docs = spread(spark, sf_dir, "documents")
    body = F.expr("repeat(text, cast(70000 div length(text) + 1 as int))").cast("binary")
    header = F.lit("02000000C801020000000001080045000000000040004006" + "00000A000001C0A80101" + "01BB1F9000000001000000005018FFFF00000000")
    return docs.select(
        F.col("doc_id").alias("packet_id"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
        F.lit("eth0").alias("iface"),
        F.concat(F.unhex(header), body).alias("raw"),
    )


def long_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_packets(spark, _written(spark, sf_dir, "long-frames", build_long_frames))


def captures(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the frames as capture files, written by Spark tasks."""
    key = (spark.sparkContext.applicationId, sf_dir, "captures")
    if key not in _FOLDERS:
        folder = scratch_dir(spark, "captures")
        files = max(3, spark.sparkContext.defaultParallelism)
        write_captures(packets_raw(spark, sf_dir).repartition(files, "packet_id"), folder)
        _FOLDERS[key] = folder
    return _FOLDERS[key]


def packets_three_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("eth"), (F.col("packet_id") % 3).cast("string"))
    return packets_raw(spark, sf_dir).withColumn("iface", name)


def interfaces(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "SELECT * FROM VALUES ('eth0', 'uplink'), ('eth1', ''), ('eth2', CAST(NULL AS STRING))"
        " AS interfaces(name, description)"
    )


def hosts_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, HOSTS_IPV6_SQL, "supplier", "nation")


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, HOSTS_SQL, "supplier", "nation")


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, NETWORKS_SQL, "nation")


def address_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, RANGES_SQL, "nation")


def build_lookups(spark: SparkSession, sf_dir: str) -> Lookups:
    """Lookup tables with deliberate gaps (see FIXTURES.md, section 4)."""
    text = FRAMES_SQL[: FRAMES_SQL.index("c as (")].rstrip().rstrip(",") + SOURCES_SQL
    sources = spark_sql(spark, sf_dir, text, "events")
    octet = F.col("octet")
    ptr = sources.filter((F.col("kind") == "ipv4") & (octet % 2 == 0)).select(
        "ip", F.concat(F.lit("host-"), octet.cast("string"), F.lit(".example")).alias("domain")
    )
    whois = sources.filter(octet % 3 == 0).select(
        "ip",
        F.concat(
            F.lit("inetnum: "), F.col("ip"), F.lit("\nnetname: NET-"), octet.cast("string"), F.lit("\n")
        ).alias("whois"),
    )
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.filter("n_nationkey < 20").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    geo = sources.join(places, octet % 25 == F.col("n_nationkey")).select(
        "ip",
        F.to_json(
            F.struct(
                F.col("n_name").alias("country"),
                F.concat(F.lit("City "), octet.cast("string")).alias("city"),
                F.col("r_name").alias("regionName"),
                (F.col("n_nationkey") + F.lit(0.5)).alias("lat"),
                (F.lit(0.25) - F.col("n_nationkey")).alias("lon"),
                F.lit("Example ISP").alias("isp"),
                F.concat(F.lit("Org "), F.col("n_name")).alias("org"),
                F.lit("UTC").alias("timezone"),
            )
        ).alias("geo_json"),
    )
    return Lookups(ptr, whois, geo)


def lookups(spark: SparkSession, sf_dir: str) -> Lookups:
    """The lookup tables as they lie on disk."""

    def stored(name: str) -> DataFrame:
        build = lambda *where: getattr(build_lookups(*where), name)
        return spark.read.parquet(_written(spark, sf_dir, f"lookup-{name}", build))

    return Lookups(stored("ptr"), stored("whois"), stored("geo"))


def build_page_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as IPv4 TCP payloads; every second one carries an HTTP status line.

    Total length 0 (as written by offloading hardware) where 16 bits are too few.
    """
    page = spread(spark, sf_dir, "pages")
    body = F.concat(
        F.when(F.col("page_id") % 2 == 0, "HTTP/1.1 200 OK\n").otherwise(""), F.col("html")
    ).cast("binary")
    total = F.length("_body") + 40
    header = F.concat(
        F.lit("02000000C8010200000000010800" + "4500"),
        F.lpad(F.hex(F.when(total > 65535, 0).otherwise(total)), 4, "0"),
        F.lit("00004000400600000A000001C0A80101"),
        F.lit("01BB1F90" + "0000000100000000" + "5018FFFF00000000"),
    )
    return page.withColumn("_body", body).select(
        F.col("page_id").alias("packet_id"),
        F.concat(F.unhex(header), F.col("_body")).alias("raw"),
    )


def page_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_written(spark, sf_dir, "page-frames", build_page_frames))
