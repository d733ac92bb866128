"""Names for protocol numbers and EtherTypes (IANA keywords)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IANA protocol keywords.
PROTOCOLS = {
    0: "HOPOPT",
    1: "ICMP",
    2: "IGMP",
    4: "IPv4",
    6: "TCP",
    8: "EGP",
    17: "UDP",
    33: "DCCP",
    41: "IPv6",
    43: "IPv6-Route",
    44: "IPv6-Frag",
    46: "RSVP",
    47: "GRE",
    50: "ESP",
    51: "AH",
    58: "IPv6-ICMP",
    59: "IPv6-NoNxt",
    60: "IPv6-Opts",
    88: "EIGRP",
    89: "OSPFIGP",
    103: "PIM",
    112: "VRRP",
    115: "L2TP",
    132: "SCTP",
    136: "UDPLite",
}

# EtherTypes.
ETHERTYPES = {
    0x0800: "IPv4",
    0x0806: "ARP",
    0x8100: "802.1Q",
    0x86DD: "IPv6",
    0x8847: "MPLS",
    0x8863: "PPPoE Discovery",
    0x8864: "PPPoE Session",
    0x88A8: "802.1ad",
    0x88CC: "LLDP",
}


def _lookup(names: dict[int, str], key: Column) -> Column:
    pairs = ", ".join(f"{number}, '{name}'" for number, name in names.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def protocol_text(number: Column) -> Column:
    """IANA keyword of an IP protocol number, or ``Protocol <n>``; null in, null out."""
    return F.coalesce(
        _lookup(PROTOCOLS, number), F.concat(F.lit("Protocol "), number.cast("string"))
    )


def ethertype_text(number: Column) -> Column:
    """Text such as ``0x0800 (IPv4)``; values up to 1500 are an 802.3 length."""
    name = F.when(number <= 1500, "Length").otherwise(
        F.coalesce(_lookup(ETHERTYPES, number), F.lit("unknown"))
    )
    digits = F.lower(F.lpad(F.hex(number), 4, "0"))
    return F.concat(F.lit("0x"), digits, F.lit(" ("), name, F.lit(")"))


def octet_text(number: Column) -> Column:
    """One byte as ``0xhh``."""
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(number), 2, "0")))
