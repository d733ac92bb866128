"""ARP sender check against a table of known IP to MAC pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decode import fields, has_layer
from .lookup import lookup_join

ARP_MODES = ("source", "all_arp", "corrected")

# The known pairs; the second one is upper case and stays so.
KNOWN_MAC = [("10.0.0.1", "00:11:22:33:44:55"), ("10.0.0.2", "66:77:88:99:AA:BB")]


def known_mac_table(spark: SparkSession) -> DataFrame:
    """The built-in pairs as ``known_mac(ip, mac)``."""
    rows = ", ".join(f"('{ip}', '{mac}')" for ip, mac in KNOWN_MAC)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS known_mac(ip, mac)")


def arp_untrusted(
    df: DataFrame, known_mac: DataFrame | None = None, mode: str = "source"
) -> DataFrame:
    """Add ``arp_untrusted``; false for frames that are not ARP.

    ``source``: untrusted unless the sender IP is known *with another MAC*
    (exact comparison) - the comparison is inverted, and kept so.
    ``all_arp``: every ARP frame.  ``corrected``: untrusted if the sender IP is
    known with another MAC, letter case ignored.
    """
    if mode not in ARP_MODES:
        raise ValueError(f"no ARP mode {mode!r}; there are {ARP_MODES}")
    df = fields(df)
    if mode == "all_arp":
        return df.withColumn("arp_untrusted", has_layer("arp"))

    if known_mac is None:
        known = known_mac_table(df.sparkSession).withColumnRenamed("mac", "_known_mac")
        joined = lookup_join(df, known, "arp_spa", "ip", "packet_id")
    else:
        # A table may be of any size: only ARP frames meet it, the others are never shuffled.
        known = known_mac.groupBy(F.trim("ip").alias("ip")).agg(F.min("mac").alias("_known_mac"))
        arp = lookup_join(df.filter(has_layer("arp")), known, "arp_spa", "ip", "packet_id")
        joined = df.filter(~has_layer("arp")).unionByName(arp, allowMissingColumns=True)

    is_known, mac = F.col("_known_mac").isNotNull(), F.col("arp_sha")
    if mode == "source":
        untrusted = ~(is_known & (F.col("_known_mac") != mac))
    else:
        untrusted = is_known & (F.lower("_known_mac") != F.lower(mac))
    return joined.withColumn(
        "arp_untrusted", F.coalesce(has_layer("arp") & untrusted, F.lit(False))
    ).drop("_known_mac")
