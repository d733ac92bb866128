"""Detection rules and the two rule sets.

A rule is a named boolean Column over the flat packet fields.  A layer that is
absent makes a rule false, never null, so rules can be negated and OR-ed.
The sets look alike but differ: the small-packet exemption, the ARP and the
certificate rules belong to ``base`` only, the IPv6 rules to ``ip`` only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arp import arp_untrusted
from .decode import fields, has_ip, has_layer

Rule = tuple[str, Callable[[], Column]]

# Frame length bounds (both fine themselves) and common protocols.
MIN_LENGTH, MAX_LENGTH = 64, 1500
COMMON_PROTOCOLS = [6, 17, 1]
DNS_PORT, TLS_PORT = 53, 443


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def valid_small_packet() -> Column:
    """TCP with ACK and none of SYN, FIN, PSH; or UDP to or from the DNS port."""
    pure_ack = (
        F.col("tcp_ack") & ~F.col("tcp_syn") & ~F.col("tcp_fin") & ~F.col("tcp_psh")
    )
    dns = (F.col("udp_src_port") == DNS_PORT) | (F.col("udp_dst_port") == DNS_PORT)
    return _true(pure_ack) | _true(dns)


def size_rule_base() -> Column:
    size = F.col("len")
    return _true((size > MAX_LENGTH) | ((size < MIN_LENGTH) & ~valid_small_packet()))


def size_rule_ip() -> Column:
    return _true(~F.col("len").between(MIN_LENGTH, MAX_LENGTH))


def uncommon_protocol_v4() -> Column:
    return _true(~F.col("ipv4_proto").isin(COMMON_PROTOCOLS))


def uncommon_protocol_v6() -> Column:
    return _true(~F.col("ipv6_next_header").isin(COMMON_PROTOCOLS))


def _syn_only() -> Column:
    return _true(F.col("tcp_syn") & ~F.col("tcp_ack"))


def syn_only_v4() -> Column:
    return has_layer("ipv4") & _syn_only()


def syn_only_v6() -> Column:
    return has_layer("ipv6") & _syn_only()


def arp_rule() -> Column:
    """Needs the column of :func:`netlens.operators.arp.arp_untrusted`."""
    return _true(F.col("arp_untrusted"))


def never_suspicious(payload: Column) -> Column:
    """The default certificate test: nothing is suspicious."""
    return F.lit(False)


def unusual_certificate(suspicious: Callable[[Column], Column] = never_suspicious) -> Column:
    """TCP on the TLS port, either side, with a payload ``suspicious`` objects to."""
    tls = (F.col("tcp_src_port") == TLS_PORT) | (F.col("tcp_dst_port") == TLS_PORT)
    return _true(tls) & _true(suspicious(F.col("tcp_payload")))


BASE_RULES: list[Rule] = [
    ("size", size_rule_base),
    ("protocol_v4", uncommon_protocol_v4),
    ("syn_v4", syn_only_v4),
    ("arp", arp_rule),
    ("certificate", unusual_certificate),
]
IP_RULES: list[Rule] = [
    ("size", size_rule_ip),
    ("protocol_v4", uncommon_protocol_v4),
    ("syn_v4", syn_only_v4),
    ("protocol_v6", uncommon_protocol_v6),
    ("syn_v6", syn_only_v6),
]
RULE_SETS = {"base": BASE_RULES, "ip": IP_RULES}


def rule_list(rules: str | list[Rule]) -> list[Rule]:
    """A rule set by name, or a list of rules as given."""
    if not isinstance(rules, str):
        return rules
    if rules not in RULE_SETS:
        raise ValueError(f"no rule set {rules!r}; there are {sorted(RULE_SETS)}")
    return RULE_SETS[rules]


def is_anomalous(rules: str | list[Rule] = "base") -> Column:
    """OR of the rules, in the order of the set."""
    result = F.lit(False)
    for _, rule in rule_list(rules):
        result = result | rule()
    return result


def first_rule(rules: str | list[Rule] = "base") -> Column:
    """Name of the first rule that fires, null if none does."""
    return F.coalesce(*[F.when(rule(), F.lit(name)) for name, rule in rule_list(rules)])


def with_rule_inputs(
    df: DataFrame,
    rules: str | list[Rule] = "base",
    known_mac: DataFrame | None = None,
    arp_mode: str = "source",
) -> DataFrame:
    """Flat packets plus what the rules need from other tables."""
    df = fields(df)
    if any(rule is arp_rule for _, rule in rule_list(rules)):
        df = arp_untrusted(df, known_mac, arp_mode)
    return df


def flag(
    df: DataFrame,
    rules: str | list[Rule] = "base",
    known_mac: DataFrame | None = None,
    arp_mode: str = "source",
) -> DataFrame:
    """Flat packets with ``anomalous`` and ``first_rule``."""
    df = with_rule_inputs(df, rules, known_mac, arp_mode)
    return df.withColumns(
        {"anomalous": is_anomalous(rules), "first_rule": first_rule(rules)}
    )


def anomalies(
    df: DataFrame,
    rules: str | list[Rule] = "base",
    known_mac: DataFrame | None = None,
    arp_mode: str = "source",
) -> DataFrame:
    """The packets at least one rule objects to."""
    return with_rule_inputs(df, rules, known_mac, arp_mode).filter(is_anomalous(rules))


def has_source_ip() -> Column:
    """Gate of the ``base`` set: only packets with a source IP are logged."""
    return has_ip()


def loggable(
    df: DataFrame,
    rules: str | list[Rule] = "base",
    known_mac: DataFrame | None = None,
    arp_mode: str = "source",
    gate: bool | None = None,
) -> DataFrame:
    """Anomalous packets that become log rows.

    The gate is on for ``base`` and off for ``ip``; for a list of your own
    rules say which.  Behind the gate no ARP frame can pass, and what remains
    carries no ARP verdict, so the ARP join is left out of the plan.
    """
    rules_list = rule_list(rules)
    gate = (rules == "base") if gate is None else gate
    if not gate:
        return anomalies(df, rules_list, known_mac, arp_mode)
    ip_rules = [(name, rule) for name, rule in rules_list if rule is not arp_rule]
    return fields(df).filter(has_source_ip() & is_anomalous(ip_rules))
