"""SQL counterparts of the registered queries, for a second engine (DuckDB).

Decode oracles read the field values the frames were built from (CTE ``k``),
never the bytes, so a decoded value is compared with an independent one.
"""

from __future__ import annotations

from .fixture import ARP_SQL, CHATS_SQL, EXTENDED_SQL, FRAMES_SQL, HOSTS_SQL, NETWORKS_SQL, RANGES_SQL, SOURCES_SQL, STEPS_SQL

# Known field values per frame; null where the layer is absent.
_KNOWN = (
    FRAMES_SQL.rstrip()
    + """,
k0 as (
  select *, length(raw_hex) // 2 as len, lower(raw_hex) as hex_text,
    kind in ('ipv4', 'ipv6') as is_ip,
    kind in ('ipv4', 'ipv6') and ip_proto = 6 as is_tcp,
    kind in ('ipv4', 'ipv6') and ip_proto = 17 as is_udp,
    cast(user_id % 250 + 1 as int) as un, cast(packet_id % 200 + 1 as int) as dn,
    '02:00:00:00:00:' || lower(u) as src_mac, '02:00:00:00:c8:' || lower(d) as dst_mac,
    case kind when 'ipv4' then 2048 when 'ipv6' then 34525 when 'arp' then 2054 else 38 end as eth_type,
    case kind when 'ipv4' then '0x0800 (IPv4)' when 'ipv6' then '0x86dd (IPv6)'
      when 'arp' then '0x0806 (ARP)' else '0x0026 (Length)' end as type_text
  from frames),
k as (
  select *,
    case kind when 'ipv4' then '10.0.' || (user_id % 4) || '.' || un
      when 'ipv6' then '2001:db8:0:0:0:0:0:' || lower(hex(un)) end as src_ip,
    case kind when 'ipv4' then '192.168.1.' || dn
      when 'ipv6' then '2001:db8:0:0:1:0:0:' || lower(hex(dn)) end as dst_ip,
    case when not is_ip then 'Unknown Protocol' else case ip_proto when 1 then 'ICMP' when 6 then 'TCP'
      when 17 then 'UDP' when 47 then 'GRE' when 58 then 'IPv6-ICMP' end end as protocol,
    case when kind = 'arp' then case packet_id % 120 when 0 then '00:11:22:33:44:55' when 40 then '66:77:88:99:aa:bb'
      when 20 then '02:00:00:00:00:ee' when 60 then '02:00:00:00:00:ee' else src_mac end end as sha,
    case when kind = 'arp' then case packet_id % 120 when 0 then '10.0.0.1' when 20 then '10.0.0.1'
      when 40 then '10.0.0.2' when 60 then '10.0.0.2' else '10.0.0.9' end end as spa,
    is_tcp and tcp_flags in (2, 18) as syn, is_tcp and tcp_flags in (18, 16, 24, 17) as ack,
    is_tcp and tcp_flags = 17 as fin, is_tcp and tcp_flags = 24 as psh
  from k0),
r as (
  select *,
    (is_tcp and tcp_flags = 16) or (is_udp and dst_port = 53) as small_ok,
    kind = 'ipv4' and ip_proto not in (1, 6, 17) as proto_v4,
    kind = 'ipv6' and ip_proto not in (1, 6, 17) as proto_v6,
    kind = 'ipv4' and is_tcp and tcp_flags = 2 as syn_v4,
    kind = 'ipv6' and is_tcp and tcp_flags = 2 as syn_v6,
    kind = 'arp' and not coalesce((spa = '10.0.0.1' and sha <> '00:11:22:33:44:55')
      or (spa = '10.0.0.2' and sha <> '66:77:88:99:AA:BB'), false) as arp_source,
    kind = 'arp' and coalesce((spa = '10.0.0.1' and sha <> '00:11:22:33:44:55')
      or (spa = '10.0.0.2' and sha <> '66:77:88:99:aa:bb'), false) as arp_corrected
  from k),
s as (
  select *, len > 1500 or (len < 64 and not small_ok) as size_base, len > 1500 or len < 64 as size_ip from r),
t as (
  select *, size_base or proto_v4 or syn_v4 or arp_source as base_hit,
    size_ip or proto_v4 or syn_v4 or proto_v6 or syn_v6 as ip_hit,
    left('len=' || len || ' eth=' || src_mac || '>' || dst_mac || ' type=' || type_text
      || case when is_ip then ' ip=' || src_ip || '>' || dst_ip || ' proto=' || protocol else '' end
      || case when is_tcp then ' tcp=' || src_port || '>' || dst_port else '' end
      || case when is_udp then ' udp=' || src_port || '>' || dst_port else '' end
      || case when kind = 'arp' then ' arp=' || spa || '@' || sha else '' end
      || ' | ' || trim(regexp_replace(hex_text, '(..)', '\\1 ', 'g')), 2000) as details
  from s)
"""
)

# The log table after one run of the base rules.
_LOGS = (
    _KNOWN.rstrip()
    + """,
logs as (
  select row_number() over (order by ts, packet_id) as id, ts as timestamp, src_ip as sourceip,
    src_mac as sourcemac, dst_ip as destinationip, dst_mac as destinationmac, protocol,
    type_text as ipversion, details
  from t where base_hit and src_ip is not null),
bodies as (
  select c_custkey as seq, timestamp '2024-02-01 00:00:00' as timestamp, c_name as sourceip,
    cast(null as varchar) as sourcemac, c_mktsegment as destinationip,
    cast(null as varchar) as destinationmac, 'HTTP' as protocol, cast(null as varchar) as ipversion,
    'nation ' || c_nationkey as details, c_nationkey
  from customer),
top as (select max(id) as last_id from logs)
"""
)

_BODY = "timestamp, sourceip, sourcemac, destinationip, destinationmac, protocol, ipversion, details"
_STREAM = "trim(regexp_replace({}, '(..)', '\\1 ', 'g'))"
_PAD = "case when len between 59 and 63 then hex_text[109:109 + (64 - len) * 2 - 1] else '' end"


def _printable(hex_expr: str) -> str:
    """Printable form of upper-case hex text."""
    return (
        f"array_to_string(list_transform(regexp_extract_all({hex_expr}, '..'), lambda p: "
        "case when p between '20' and '7E' then chr(cast('0x' || p as int)) else '\\x' || p end), '')"
    )


def _frames(select: str, where: str = "true", source: str = "t") -> str:
    return f"{_KNOWN} select {select} from {source} where {where}"


_RECORD = (
    "packet_id, ts as timestamp, src_ip as sourceip, case when is_ip then src_mac end as sourcemac, "
    "dst_ip as destinationip, case when is_ip then dst_mac end as destinationmac, protocol, "
    "case when is_ip then type_text end as ipversion, details"
)

_LOOKUPS = (
    _KNOWN.rstrip()
    + f""",
sources as ({SOURCES_SQL}),
geo as (
  select ip, n_name as country, 'City ' || octet as city, r_name as region_name, n_nationkey + 0.5::double as lat,
    0.25::double - n_nationkey as lon, 'Example ISP' as isp, 'Org ' || n_name as org, 'UTC' as timezone
  from sources join nation on octet % 25 = n_nationkey join region on n_regionkey = r_regionkey
  where n_nationkey < 20),
info as (
  select s.ip, case when kind = 'ipv4' and octet % 2 = 0 then 'host-' || octet || '.example' end as domain,
    case when octet % 3 = 0 then 'inetnum: ' || s.ip || chr(10) || 'netname: NET-' || octet || chr(10) end as whois,
    country, region_name
  from sources s left join geo using (ip))
"""
)


def _info(prefix: str, side: str, ip: str) -> str:
    return (
        f"{side}.domain as {prefix}domainName, {side}.whois as {prefix}whoisData, "
        f"{side}.country as {prefix}country, {side}.region_name as {prefix}region_name, "
        f"case when {ip} is null then null when {side}.country is null then 'error' else 'ok' end as {prefix}status"
    )


_VIEW = (
    f"packet_id, dst_mac as destination_address, src_mac as source_address, type_text as type, "
    f"case when kind = 'llc' then '0x42' end as dsap, case when kind = 'llc' then '0x42' end as ssap, "
    f"case when kind = 'llc' then '0x03' end as control, {_STREAM.format('hex_text')} as data_hex_stream, "
    f"{_STREAM.format(_PAD)} as ethernet_pad_hex_stream, src_ip as source_ip, dst_ip as destination_ip"
)


def _json_text(expr: str) -> str:
    return f"coalesce('\"' || {expr} || '\"', 'null')"


_JSON = (
    "'{\"packet_id\":' || packet_id || ',\"ethernetHeader\":{\"destinationAddress\":\"' || dst_mac"
    " || '\",\"sourceAddress\":\"' || src_mac || '\",\"type\":\"' || type_text || '\"},\"llcHeader\":'"
    " || case when kind = 'llc' then '{\"dsap\":\"0x42\",\"ssap\":\"0x42\",\"control\":\"0x03\"}' else 'null' end"
    f" || ',\"dataHexStream\":\"' || {_STREAM.format('hex_text')} || '\",\"ethernetPadHexStream\":\"'"
    f" || {_STREAM.format(_PAD)} || '\",\"sourceIpAddress\":' || {_json_text('src_ip')}"
    f" || ',\"destinationIpAddress\":' || {_json_text('dst_ip')} || '}}'"
).replace("}}'", "}'")

_UPSERTED = (
    f"{_LOGS}, upd as (select *, case c_nationkey when 4 then null when 5 then seq + 2 when 6 then seq + 10000000 "
    "else seq end as body_id from bodies where c_nationkey <> 3 and seq in (select id from logs)), "
    "rep as (select * from upd where body_id in (select id from logs) "
    "qualify row_number() over (partition by body_id order by seq desc) = 1), "
    "fresh as (select * from upd where body_id is null or body_id not in (select id from logs)) "
    f"select id, {_BODY} from logs where id not in (select body_id from rep) "
    f"union all select body_id, {_BODY} from rep "
    f"union all select last_id + row_number() over (order by seq), {_BODY} from fresh, top"
)

_ACCOUNTS = """
with target as (select c_custkey as key, c_custkey as seq from customer),
batch as (
  select case when o_orderstatus <> 'P' then o_custkey * 2 end as key, o_orderkey as seq from orders),
judged as (
  select key, seq, key is null or (
    row_number() over (partition by key order by seq) = 1
    and not exists (select 1 from target t where t.key = batch.key)) as accepted
  from batch)
"""

_STEPS = (
    STEPS_SQL.rstrip()
    + """,
flows as (
  select packet_id, ts, flags, event_id, '10.0.' || (user_id % 4) || '.' || (user_id % 250 + 1) as client, client_port,
    '192.168.1.' || dn as server from steps),
opened as (
  select packet_id, ts, client as src_ip, cast(client_port as int) as src_port, server as dst_ip, cast(443 as int) as dst_port
  from flows s where flags = 2 and not exists (
    select 1 from flows a where a.flags in (16, 24) and a.client = s.client and a.client_port = s.client_port
      and a.server = s.server and a.ts > s.ts and a.ts <= s.ts + interval 30 second)),
rates as (
  select unnest([time_bucket(interval 1 hour, ts) - interval 1 hour, time_bucket(interval 1 hour, ts)]) as window_start,
    dst_ip, src_ip from opened)
"""
)
_RATES = (
    f"{_STEPS} select window_start, window_start + interval 2 hour as window_end, dst_ip, count(*) as n_half_open, "
    "count(distinct src_ip) as n_sources from rates group by window_start, dst_ip having count(*) >= 5"
)
_CLAIMS = (
    ARP_SQL.rstrip()
    + """,
seen as (
  select packet_id, ts, '10.0.' || net || '.' || octet as ip, '02:00:00:00:00:' || lower(lpad(hex(mac), 2, '0')) as mac from claims),
changed as (
  select * from (select *, lag(mac) over (partition by ip order by ts, packet_id) as previous from seen)
  where previous is null or previous <> mac)
"""
)

_HANDSHAKES = """
with c as (
  select c_custkey as k, case when c_custkey % 11 = 0 then c_name else 'TrustedCA' || c_nationkey end as issuer_cn, c_name,
    c_custkey % 11 <> 0 and c_nationkey in (1, 2, 3) as trusted, timestamp '2024-03-01' + (c_custkey % 1000) * interval 1 minute as begun
  from customer),
shown as (
  select k, '10.' || (k // 65536 % 256) || '.' || (k // 256 % 256) || '.' || (k % 256) as src_ip, cast(1024 + k % 50000 as int) as dst_port,
    'O=Example, CN=' || issuer_cn as issuer, issuer_cn, 'O=Example, CN=' || c_name as subject, '01' || lower(lpad(hex(k), 8, '0')) as serial,
    case when k % 7 = 0 then timestamp '2025-01-01' else timestamp '2023-01-01' end as not_before,
    case when k % 5 = 0 then timestamp '2023-12-31 23:59:59' else timestamp '2051-12-31 23:59:59' end as not_after,
    cast(2 as int) as chain, begun + interval 1 millisecond as shown_at,
    array_to_string(list_filter([case when not trusted then 'issuer' end, case when k % 11 = 0 then 'self_signed' end,
      case when k % 5 = 0 then 'expired' end, case when k % 7 = 0 then 'not_yet_valid' end], lambda x: x is not null), ',') as reasons
  from c)
"""

_IN_HOSTS = "in (select ip from hosts)"

ORACLE_SQL: dict[str, str] = {
    "decode_ethernet": _frames("packet_id, dst_mac as eth_dst, src_mac as eth_src, eth_type"),
    "decode_llc": _frames("packet_id, 66 as dsap, 66 as ssap, 3 as control", "kind = 'llc'"),
    "decode_ipv4": _frames(
        "packet_id, src_ip as src, dst_ip as dst, cast(ip_proto as int) as proto, 20 as ihl", "kind = 'ipv4'"
    ),
    "decode_ipv6": _frames(
        "packet_id, src_ip as src, dst_ip as dst, cast(ip_proto as int) as next_header", "kind = 'ipv6'"
    ),
    "decode_arp": _frames(
        "packet_id, spa, sha, '192.168.1.' || dn as tpa, '00:00:00:00:00:00' as tha, 1 as op", "kind = 'arp'"
    ),
    "decode_tcp": _frames(
        "packet_id, cast(src_port as int) as src_port, cast(dst_port as int) as dst_port, syn, ack, fin, psh, "
        "coalesce(nullif(lower(body_hex), ''), 'none') as payload_hex",
        "is_tcp",
    ),
    "decode_udp": _frames(
        "packet_id, cast(src_port as int) as src_port, cast(dst_port as int) as dst_port", "is_udp"
    ),
    "decode_layers": _frames(
        "packet_id, true as has_eth, kind = 'llc' as has_llc, kind = 'ipv4' as has_ipv4, kind = 'ipv6' as has_ipv6, "
        "kind = 'arp' as has_arp, is_tcp as has_tcp, is_udp as has_udp"
    ),
    "resolve_ips": _frames('packet_id, src_ip as "sourceIp", dst_ip as "destinationIp"'),
    "decode_tagged": _frames(
        "packet_id, cast(case packet_id % 3 when 1 then 33024 when 2 then 34984 else eth_type end as int) as eth_type, "
        "case when kind = 'llc' then 3 end as llc_control, spa as arp_spa, sha as arp_sha, "
        "case when is_tcp then cast(dst_port as int) end as tcp_dst_port, case when is_tcp then syn end as tcp_syn, "
        "case when is_udp then cast(dst_port as int) end as udp_dst_port, src_ip as src, dst_ip as dst"
    ),
    "anomalies_ip_tagged": _frames(
        "packet_id",
        "len + 4 * (packet_id % 3) > 1500 or len + 4 * (packet_id % 3) < 64 or proto_v4 or syn_v4 or proto_v6 or syn_v6",
    ),
    "decode_ipv6_ext": (
        FRAMES_SQL.rstrip() + EXTENDED_SQL + "select packet_id, cast(case chain when 0 then ip_proto else 0 end as int) as ipv6_next_header, "
        "case when ip_proto = 6 and chain <> 3 then cast(dst_port as int) end as tcp_dst_port, "
        "case when ip_proto = 6 and chain <> 3 then tcp_flags in (2, 18) end as tcp_syn, "
        "case when ip_proto = 17 and chain <> 3 then cast(dst_port as int) end as udp_dst_port, "
        "case when ip_proto = 6 and chain <> 3 and body_hex <> '' then lower(body_hex) else 'none' end as payload_hex "
        "from extended where kind = 'ipv6'"
    ),
    "long_frames": (
        "with b as (select doc_id, repeat(text, 70000 // length(text) + 1) as body from documents) select doc_id, "
        "cast(strlen(body) + 54 as int) as len, cast(strlen(body) as int) as payload_bytes, sha256(body) as payload_sha256 from b"
    ),
    "pcap_frames": _frames(
        "ts, 'eth0' as iface, cast(len as int) as len, spa as arp_spa, "
        "case when is_tcp then cast(dst_port as int) end as tcp_dst_port, hex_text as raw_hex"
    ),
    "stream_captures": f"{_LOGS} select {_BODY} from logs",
    "protocol_name": _frames("packet_id, protocol"),
    "packet_length": _frames("packet_id, cast(len as int) as len"),
    "hex_stream": _frames(f"packet_id, {_STREAM.format('hex_text')} as hex_stream"),
    "hex_to_bytes": _frames("packet_id, hex_text as bytes_hex"),
    "ethernet_pad": _frames(f"packet_id, {_PAD} as pad_hex, {_STREAM.format(_PAD)} as pad_stream"),
    "printable_documents": (
        f"with h as (select doc_id, hex(text) as hx from documents) select doc_id, {_printable('hx')} as printable from h"
    ),
    "payload_text_pages": (
        "with h as (select page_id, hex(html) as hx, html from pages) select page_id, "
        f"case when page_id % 2 = 0 then 'HTTP/1.1 200 OK' || chr(10) || html when contains(html, 'HTTP') then html "
        f"else {_printable('hx')} end as payload_text from h"
    ),
    "payload_text_frames": _frames(
        f"packet_id, case when kind = 'ipv4' and is_tcp then (case when want_len > 64 and contains(body, 'HTTP') then body "
        f"else {_printable('body_hex')} end) else {_printable('raw_hex')} end as payload_text"
    ),
    "packet_view": _frames(_VIEW),
    "display_packets": (
        f"{_KNOWN}, v as (select {_VIEW} from t) select packet_id, destination_address as destination_host, "
        "destination_ip, source_address as source_host, source_ip, type, coalesce(dsap, '') as llc_dsap, "
        "coalesce(ssap, '') as llc_ssap, coalesce(control, '') as llc_control, data_hex_stream as data, "
        "ethernet_pad_hex_stream as ethernet_pad from v where destination_ip <> ''"
    ),
    "count_records": "select count(*) as n from events",
    "json_rows": _frames(f"{_JSON} as value"),
    "select_interface": "select event_id as packet_id, 'eth1' as iface from events where event_id % 3 = 1",
    "list_interfaces": (
        "with known(name, description) as (values ('eth0', 'uplink'), ('eth1', ''), ('eth2', null)) "
        "select distinct name, description, coalesce(nullif(description, ''), name) as label "
        "from known join events on name = 'eth' || (event_id % 3)"
    ),
    "snaplen_96": _frames(
        "packet_id, cast(least(len, 96) as int) as len, least(len, 96) < 64 as size_ip"
    ),
    "host_filter": _frames(
        "packet_id", "src_ip = '10.0.1.2' or dst_ip = '10.0.1.2' or spa = '10.0.1.2'"
    ),
    "host_filter_arp": _frames(
        "packet_id", "src_ip = '10.0.0.2' or dst_ip = '10.0.0.2' or spa = '10.0.0.2'"
    ),
    "host_filter_ipv6": _frames("packet_id", "src_ip = '2001:db8:0:0:0:0:0:4' or dst_ip = '2001:db8:0:0:0:0:0:4'"),
    "host_set_filter_ipv6": (
        f"{_KNOWN}, hosts as (select '2001:db8:0:0:0:0:0:' || lower(hex(s_suppkey)) as ip from supplier "
        "union select '2001:db8:0:0:1:0:0:' || lower(hex(n_nationkey + 16)) from nation) "
        f"select packet_id from t where src_ip {_IN_HOSTS} or dst_ip {_IN_HOSTS}"
    ),
    "host_set_filter": (
        f"{_KNOWN}, hosts as ({HOSTS_SQL}) select packet_id from t where src_ip {_IN_HOSTS} or dst_ip {_IN_HOSTS} "
        f"or (kind = 'arp' and (spa {_IN_HOSTS} or '192.168.1.' || dn {_IN_HOSTS}))"
    ),
    "rule_size_base": _frames("packet_id, size_base as hit"),
    "rule_size_ip": _frames("packet_id, size_ip as hit"),
    "rule_small_ok": _frames("packet_id, small_ok as hit"),
    "rule_proto_v4": _frames("packet_id, proto_v4 as hit"),
    "rule_proto_v6": _frames("packet_id, proto_v6 as hit"),
    "rule_syn_v4": _frames("packet_id, syn_v4 as hit"),
    "rule_syn_v6": _frames("packet_id, syn_v6 as hit"),
    "rule_certificate": "select event_id as packet_id, false as hit from events",
    "rule_certificate_hook": _frames("packet_id, is_tcp and dst_port = 443 and body_hex <> '' as hit"),
    "rule_arp_source": _frames("packet_id, arp_source as hit"),
    "rule_arp_all_arp": _frames("packet_id, kind = 'arp' as hit"),
    "rule_arp_corrected": _frames("packet_id, arp_corrected as hit"),
    "anomalies_base": _frames("packet_id", "base_hit"),
    "anomalies_ip": _frames("packet_id", "ip_hit"),
    "first_rule_base": _frames(
        "packet_id, case when size_base then 'size' when proto_v4 then 'protocol_v4' when syn_v4 then 'syn_v4' "
        "when arp_source then 'arp' else 'none' end as first_rule"
    ),
    "first_rule_ip": _frames(
        "packet_id, case when size_ip then 'size' when proto_v4 then 'protocol_v4' when syn_v4 then 'syn_v4' "
        "when proto_v6 then 'protocol_v6' when syn_v6 then 'syn_v6' else 'none' end as first_rule"
    ),
    "log_records_base": _frames(_RECORD, "base_hit and src_ip is not null"),
    "log_records_ip": _frames(_RECORD, "ip_hit"),
    "logs_valid": _frames(
        "packet_id, src_ip as sourceip, dst_ip as destinationip, protocol", "ip_hit and src_ip is not null"
    ),
    "logs_rejected": _frames(
        "packet_id, 'sourceip not null, destinationip not null' as violations", "ip_hit and src_ip is null"
    ),
    "display_logs": f"{_LOGS} select id, {_BODY} from logs",
    "log_get": f"{_LOGS} select id, {_BODY} from logs where id = 7",
    "log_insert": (
        f"{_LOGS} select id, {_BODY} from logs union all "
        f"select last_id + row_number() over (order by seq), {_BODY} from bodies, top"
    ),
    "log_upsert": _UPSERTED,
    "log_table": (
        f"select * from ({_UPSERTED}) where id not in (select s_suppkey * 3 - 6 from supplier)"
    ),
    "log_delete": (
        f"{_LOGS} select id, {_BODY} from logs where id not in (select s_suppkey * 3 - 6 from supplier)"
    ),
    "upsert_rejected": (
        "select c_custkey as seq, case c_nationkey when 7 then 'destinationip not null' else 'protocol max 100' end as violations "
        "from customer where c_nationkey in (7, 8)"
    ),
    "logs_too_long": "select doc_id, 'details max 2000' as violations from documents where length(text) > 2000",
    "insert_if_absent": (
        f"{_ACCOUNTS} select coalesce(key, -1) as key, seq from target union all "
        "select coalesce(key, -1), seq from judged where accepted"
    ),
    "insert_refused": f"{_ACCOUNTS} select key, seq from judged where not accepted",
    "key_exists": (
        'select c_custkey, c_custkey in (select o_custkey from orders) as "exists" from customer'
    ),
    "enrich_ip": (
        f"{_LOOKUPS} select packet_id, t.src_ip as ip_address, {_info('', 'i', 't.src_ip')} "
        "from t left join info i on t.src_ip = i.ip"
    ),
    "enrich_both_ends": (
        f"{_LOOKUPS} select packet_id, t.src_ip as sourceip, t.dst_ip as destinationip, "
        f"{_info('src_', 'a', 't.src_ip')}, {_info('dst_', 'z', 't.dst_ip')} from t "
        "left join info a on t.src_ip = a.ip left join info z on t.dst_ip = z.ip "
        "where base_hit and t.src_ip is not null"
    ),
    "geo_fields": (
        f'{_LOOKUPS} select ip, country, city, region_name as "regionName", lat, lon, isp, org, timezone from geo'
    ),
    "trusted_issuer": (
        "select c_custkey, 'TrustedCA' || c_nationkey as issuer, c_nationkey in (1, 2, 3) as trusted from customer"
    ),
    "stream_detect": f"{_LOGS} select {_BODY} from logs",
    "stream_restart": _frames(_RECORD.replace("packet_id, ", "", 1), "ip_hit and src_ip is not null"),
    "stream_two_captures": (
        f"{_KNOWN}, u as (select *, 1 as side from t where base_hit and src_ip is not null "
        "union all select *, 2 from t where ip_hit and src_ip is not null) "
        f"select {_RECORD.replace('packet_id, ', '', 1)} from u"
    ),
    "stream_snapshot": _frames(
        "packet_id, cast(len as int) as len, src_ip, (select count(*) from events) as seen_running"
    ),
    "syn_half_open": f"{_STEPS} select * from opened",
    "syn_rates": _RATES,
    "stream_syn_rates": _RATES,
    "mac_history": (
        f"{_CLAIMS} select ip, mac, previous, ts as valid_from, lead(ts) over (partition by ip order by ts, packet_id) as valid_to from changed"
    ),
    "mac_in_force": (
        f"{_CLAIMS}, {FRAMES_SQL.strip().removeprefix('with ')}, "
        "p as (select packet_id * 2 as packet_id, ts + interval 1 second as ts, '10.0.' || (user_id % 4) || '.' || (user_id % 250 + 1) as ip, "
        "'02:00:00:00:00:' || lower(u) as eth_src from frames where kind = 'ipv4') "
        "select p.packet_id, p.ip as ipv4_src, c.mac as bound_mac, c.ts as bound_since, coalesce(c.mac <> eth_src, false) as mac_differs "
        "from p asof left join changed c on p.ip = c.ip and p.ts >= c.ts"
    ),
    "stream_mac_changes": f"{_CLAIMS} select ip, mac, previous, ts, packet_id from changed",
    "tcp_streams": (
        "select '10.' || (doc_id // 65536 % 256) || '.' || (doc_id // 256 % 256) || '.' || (doc_id % 256) as src_ip, "
        "cast(1 - doc_id % 2 as bigint) as connection, cast(strlen(text) as bigint) as n_bytes, sha256(text) as sha256 "
        "from documents where text <> ''"
    ),
    "tls_certificates": f"{_HANDSHAKES} select * exclude (k) from shown",
    "rule_certificate_flow": (
        f"{_HANDSHAKES} select unnest(range(k * 10, k * 10 + 5)) as packet_id, "
        "array_to_string(list_sort(string_split(reasons, ',')), ',') as reasons from shown where reasons <> ''"
    ),
    "match_prefixes": (
        f"{_KNOWN}, nets as ({NETWORKS_SQL}), "
        "n as (select *, string_split(prefix, '/')[1] as net, cast(string_split(prefix, '/')[2] as int) as size from nets), "
        "hit as (select packet_id, label, size from t join n on kind = 'ipv4' and not contains(net, ':') and "
        "(cast(string_split(src_ip, '.')[1] as bigint) * 16777216 + cast(string_split(src_ip, '.')[2] as bigint) * 65536 "
        "+ cast(string_split(src_ip, '.')[3] as bigint) * 256 + cast(string_split(src_ip, '.')[4] as bigint)) // (1::bigint << (32 - size)) = "
        "(cast(string_split(net, '.')[1] as bigint) * 16777216 + cast(string_split(net, '.')[2] as bigint) * 65536 "
        "+ cast(string_split(net, '.')[3] as bigint) * 256 + cast(string_split(net, '.')[4] as bigint)) // (1::bigint << (32 - size)) "
        "union all select packet_id, label, size from t join n on kind = 'ipv6' and (size = 32 or (contains(net, '::') and size = 124 and "
        "un // 16 = cast('0x' || string_split(net, '::')[2] as int) // 16))) "
        "select t.packet_id, src_ip as ip_address, arg_max(label, size) as label from t left join hit using (packet_id) group by t.packet_id, src_ip"
    ),
    "match_ranges": (
        f"{_KNOWN}, spans as (select label, string_split(first, '.') as a, string_split(last, '.') as z from ({RANGES_SQL})), "
        "hit as (select packet_id, label, cast(z[4] as int) - cast(a[4] as int) as size, cast(a[4] as int) as begin, cast(z[4] as int) as stop from t join spans on kind = 'ipv4' "
        "and string_split(src_ip, '.')[3] = a[3] and un between cast(a[4] as int) and cast(z[4] as int)) select packet_id, label from hit"
    ),
    "flow_sessions": (
        CHATS_SQL.rstrip() + """,
p as (select *, cast(case when is_udp then 17 else 6 end as int) as proto, not is_udp and flags = 2 as opens, not is_udp and flags in (17, 4) as closes from chats),
c as (select *, coalesce(sum(closes::int) over w, 0) as n_closed, lag(ts) over (partition by proto, client, port order by ts, packet_id) as last_ts
      from p window w as (partition by proto, client, port order by ts, packet_id rows between unbounded preceding and 1 preceding)),
s as (select *, coalesce(last_value(case when opens then n_closed end ignore nulls) over w, 0) as at_syn
      from c window w as (partition by proto, client, port order by ts, packet_id rows between unbounded preceding and 1 preceding)),
n as (select *, sum((last_ts is null or ts > last_ts + interval 12 hour or (opens and n_closed > at_syn))::int)
        over (partition by proto, client, port order by ts, packet_id) as session from s)
select proto, '10.0.0.' || client as low_ip, cast(port as int) as low_port, '192.168.1.1' as high_ip, cast(443 as int) as high_port,
  cast(session as bigint) as session, min(ts) as first_ts, max(ts) as last_ts, count(*) as n_packets,
  cast(sum(case when is_udp then 42 else 54 end) as bigint) as n_bytes, count(*) filter (reply = 0) as n_from_low, bool_or(opens) as opened, bool_or(closes) as closed
from n group by proto, client, port, session"""
    ),
    "packet_page": f"{_KNOWN} select packet_id, ts, cast(len as int) as len, src_ip from t order by ts, packet_id limit 300 offset 600",
    "log_page": f"{_LOGS} select id, {_BODY} from logs where id between 201 and 400",
    "stream_new_packets": _frames("packet_id, cast(len as int) as len, src_ip", "packet_id % 2 = 1"),
    "buffer_clear": _frames("packet_id, cast(len as int) as len, src_ip, cast(0 as int) as left"),
    "packet_buffer": _frames(
        "packet_id, cast(len as int) as len, src_ip, dst_ip, 'eth0' as iface, raw_hex"
    ),
}

ORACLE_SQL["pcap_source"] = ORACLE_SQL["pcap_frames"]
for _name in ("enrich_both_ends", "host_set_filter", "key_exists"):
    ORACLE_SQL[f"{_name}_shuffled"] = ORACLE_SQL[_name]
