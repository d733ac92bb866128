"""Which MAC address an IP address had, and when: from the ARP frames themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join, bucket_of
from .decode import fields, has_layer, source_ip

#: An ARP probe names no sender.
NO_ADDRESS = "0.0.0.0"
#: Seconds of a bucket in which observations are thinned out first.
WIDTH = 3_600


def observations(packets: DataFrame) -> DataFrame:
    """``ip, mac, ts, packet_id`` of every ARP sender."""
    flat = fields(packets).filter(has_layer("arp") & (F.col("arp_spa") != NO_ADDRESS))
    return flat.select(F.col("arp_spa").alias("ip"), F.col("arp_sha").alias("mac"), "ts", "packet_id")


def _starts(rows: DataFrame, *part: str) -> DataFrame:
    """Rows whose MAC is not the one before, inside each part."""
    before = F.lag("mac").over(Window.partitionBy(*part).orderBy("ts", "packet_id"))
    return rows.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col("mac")) | F.col("_before").isNull()).drop("_before")


def changes(seen: DataFrame, width: int = WIDTH) -> DataFrame:
    """The observations that change a binding: ``ip, mac, ts, packet_id, previous``.

    First inside buckets of time, so that an address seen in a third of all frames is many small
    parts; what begins a stretch in its bucket is then compared over the buckets.
    """
    in_bucket = _starts(seen.withColumn("_bucket", bucket_of(F.col("ts"), width)), "ip", "_bucket").drop("_bucket")
    over = Window.partitionBy("ip").orderBy("ts", "packet_id")
    named = in_bucket.withColumn("previous", F.lag("mac").over(over))
    return named.where(F.col("previous").isNull() | (F.col("previous") != F.col("mac")))


def mac_history(packets: DataFrame, width: int = WIDTH) -> DataFrame:
    """Validity of each binding: ``ip, mac, previous, valid_from, valid_to``, the last one open (null)."""
    over = Window.partitionBy("ip").orderBy("ts", "packet_id")
    found = changes(observations(packets), width)
    return found.select("ip", "mac", "previous", F.col("ts").alias("valid_from"), F.lead("ts").over(over).alias("valid_to"))


def mac_in_force(packets: DataFrame, history: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """Flat packets with ``bound_mac``, ``bound_since`` and ``mac_differs``.

    The binding of the packet's source address at its time.  ``mac_differs``: the frame came from
    another MAC than the one bound; false where none is known.  ``history`` takes the
    ``changes`` of other frames, such as stored ones.
    """
    flat = fields(packets).withColumn("_ip", F.coalesce(source_ip(), F.nullif("arp_spa", F.lit(NO_ADDRESS))))
    known = changes(observations(packets), width) if history is None else history
    known = known.select(F.col("ip").alias("_ip"), "ts", "packet_id", F.col("mac").alias("bound_mac"), F.col("ts").alias("bound_since"))
    joined = asof_join(flat, known, "_ip", "ts", "packet_id", ["bound_mac", "bound_since"], width)
    differs = F.coalesce(F.col("bound_mac") != F.col("eth_src"), F.lit(False))
    return joined.withColumn("mac_differs", differs).drop("_ip")
