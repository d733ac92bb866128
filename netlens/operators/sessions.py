"""Sessions: the packets of a flow, in either direction, up to a pause or a new connection.

A flow is a protocol and two ends, whichever sends.  In order of capture a session begins at the
flow's first packet, after a pause of more than ``idle`` seconds, and at a SYN (without ACK) that
follows a FIN or RST sent since the flow's last SYN.  What comes behind a FIN, such as its ACK,
still belongs to the session it closes.

A flow is cut into buckets of time first; inside a bucket everything but its first packet and its
first SYN is decided there.  These two are decided over the buckets, one row each, and the
sessions are numbered through.  So a flow with a third of all packets is many small windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .asof import bucket_of
from .decode import transport_packets

FLOW = ["proto", "low_ip", "low_port", "high_ip", "high_port"]
IDLE = 300
#: Seconds of a bucket.
WIDTH = 3_600


def flow_packets(packets: DataFrame) -> DataFrame:
    """TCP and UDP packets with their flow: its two ends in order, and whether the lower one sent."""
    rows = transport_packets(packets)
    source, target = F.struct("src_ip", "src_port"), F.struct(F.col("dst_ip").alias("src_ip"), F.col("dst_port").alias("src_port"))
    rows = rows.withColumns({"_low": F.least(source, target), "_high": F.greatest(source, target), "from_low": source <= target})
    ends = {"low_ip": "_low.src_ip", "low_port": "_low.src_port", "high_ip": "_high.src_ip", "high_port": "_high.src_port"}
    return rows.select("packet_id", "ts", "proto", *[F.col(path).alias(name) for name, path in ends.items()], "from_low", "size", "opens", "closes")


def numbered(rows: DataFrame, idle: int = IDLE, width: int = WIDTH) -> DataFrame:
    """``rows`` of ``flow_packets`` with ``session``, from 1 in each flow."""
    order = F.struct("ts", "packet_id")
    inside = Window.partitionBy(*FLOW, "_bucket").orderBy("ts", "packet_id")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pause = F.make_dt_interval(secs=F.lit(idle))

    marked = rows.withColumn("_bucket", bucket_of(F.col("ts"), width))
    marked = marked.withColumns(
        {"_last": F.lag("ts").over(inside), "_closed": F.coalesce(F.sum(F.col("closes").cast("long")).over(before), F.lit(0))}
    )
    marked = marked.withColumn("_at_syn", F.last(F.when(F.col("opens"), F.col("_closed")), ignorenulls=True).over(before))
    again = F.col("opens") & F.col("_at_syn").isNotNull() & (F.col("_closed") > F.col("_at_syn"))
    rested = F.col("_last").isNotNull() & (F.col("ts") > F.col("_last") + pause)
    marked = marked.withColumns({"_begins": again | rested, "_first_syn": F.col("opens") & F.col("_at_syn").isNull(), "_first": F.col("_last").isNull()})
    marked = marked.withColumns({"_begun": F.sum(F.col("_begins").cast("long")).over(so_far), "_syn_met": F.col("_first_syn") | F.col("_at_syn").isNotNull()})
    marked = stored(marked.drop("_last", "_at_syn"), "sessions")

    closes = F.col("closes").cast("long")
    sums = marked.groupBy(*FLOW, "_bucket").agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sum(closes).alias("n_closed"),
        F.sum(F.col("_begins").cast("long")).alias("n_begun"),
        F.max(F.when(F.col("_first_syn"), F.col("_closed"))).alias("closed_first_syn"),
        F.max_by("_closed", F.when(F.col("opens"), order)).alias("closed_last_syn"),
        F.bool_or(F.col("_first_syn") & (F.col("_first") | F.col("_begins"))).alias("syn_begins"),
        F.bool_or(F.col("_first_syn") & F.col("_first")).alias("syn_is_first"),
    )
    over = Window.partitionBy(*FLOW).orderBy("_bucket")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_all", F.coalesce(F.sum("n_closed").over(earlier), F.lit(0)))
    sums = sums.withColumns(
        {
            "_at_syn": F.last(F.col("_all") + F.col("closed_last_syn"), ignorenulls=True).over(earlier),
            "_last_ts": F.lag("last_ts").over(over),
        }
    )
    first_begins = F.col("_last_ts").isNull() | (F.col("first_ts") > F.col("_last_ts") + pause)
    syn_again = F.col("closed_first_syn").isNotNull() & (F.col("_all") + F.col("closed_first_syn") > F.coalesce("_at_syn", F.lit(0)))
    sums = sums.withColumn("_head", first_begins | (syn_again & F.col("syn_is_first")))
    sums = sums.withColumn("_syn", syn_again & ~F.col("syn_begins"))
    total = F.col("n_begun") + F.col("_head").cast("long") + F.col("_syn").cast("long")
    carried = sums.select(
        *FLOW,
        "_bucket",
        (F.coalesce(F.sum(total).over(earlier), F.lit(0)) + F.col("_head").cast("long")).alias("_base"),
        F.col("_syn").cast("long").alias("_own"),
    )
    joined = marked.join(carried, [*FLOW, "_bucket"])
    session = F.col("_base") + F.col("_begun") + F.when(F.col("_syn_met"), F.col("_own")).otherwise(0)
    return joined.select(*rows.columns, session.alias("session"))


def sessions(packets: DataFrame, idle: int = IDLE, width: int = WIDTH) -> DataFrame:
    """One row for each session: flow, session, first_ts, last_ts, n_packets, n_bytes, n_from_low,
    opened (it has a SYN), closed (it has a FIN or RST)."""
    rows = numbered(flow_packets(packets), idle, width)
    return rows.groupBy(*FLOW, "session").agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count("*").alias("n_packets"),
        F.sum("size").alias("n_bytes"),
        F.count_if("from_low").alias("n_from_low"),
        F.bool_or("opens").alias("opened"),
        F.bool_or("closes").alias("closed"),
    )
