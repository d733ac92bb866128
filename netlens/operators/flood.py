"""SYN floods: connections that a source opens and never completes, counted by destination.

A SYN (without ACK) is half-open if no packet of the same flow with ACK and without SYN follows
within ``timeout`` seconds.  Half-open SYNs are counted in sliding windows, first by
destination and source, then by destination, so that one destination with a third of all packets is
counted by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import bucket_of
from .decode import destination_ip, fields, has_layer, source_ip

FLOW = ["src_ip", "src_port", "dst_ip", "dst_port"]
TIMEOUT = 30


def tcp_flows(packets: DataFrame) -> DataFrame:
    """``packet_id, ts``, the flow, and whether the packet asks for or acknowledges a connection."""
    flat = fields(packets).filter(has_layer("tcp"))
    return flat.select(
        "packet_id",
        "ts",
        source_ip().alias("src_ip"),
        F.col("tcp_src_port").alias("src_port"),
        destination_ip().alias("dst_ip"),
        F.col("tcp_dst_port").alias("dst_port"),
        (F.col("tcp_syn") & ~F.col("tcp_ack")).alias("asks"),
        (F.col("tcp_ack") & ~F.col("tcp_syn")).alias("answers"),
    )


def half_open(packets: DataFrame, timeout: int = TIMEOUT) -> DataFrame:
    """The half-open SYNs: ``packet_id, ts`` and the flow.

    Answers become two rows for each flow and bucket of ``timeout`` seconds: the last one, for
    SYNs of the same bucket, and the first one, for those of the bucket before.  They are
    combined before the shuffle, and a SYN meets one row.
    """
    flows = tcp_flows(packets).withColumn("bucket", bucket_of(F.col("ts"), timeout))
    ends = F.explode(F.array(F.struct("bucket", F.col("ts").alias("here"), F.lit(None).cast("timestamp_ntz").alias("after")), F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(None).cast("timestamp_ntz").alias("here"), F.col("ts").alias("after"))))
    answers = flows.where("answers").select(*FLOW, ends.alias("e")).groupBy(*FLOW, F.col("e.bucket").alias("bucket"))
    answers = answers.agg(F.max("e.here").alias("last_here"), F.min("e.after").alias("first_after"))
    met = flows.where("asks").join(answers, [*FLOW, "bucket"], "left")
    in_time = F.col("first_after") <= F.col("ts") + F.make_dt_interval(secs=F.lit(timeout))
    done = F.coalesce(F.col("last_here") > F.col("ts"), F.lit(False)) | F.coalesce(in_time, F.lit(False))
    return met.where(~done).select("packet_id", "ts", *FLOW)


def rates(opened: DataFrame, window: str, slide: str, least: int, at: str = "ts") -> DataFrame:
    """``window_start, window_end, dst_ip, n_half_open, n_sources`` of windows with at least ``least``."""
    by_source = opened.groupBy(F.window(at, window, slide).alias("window"), "dst_ip", "src_ip").agg(F.count("*").alias("n"))
    by_target = by_source.groupBy("window", "dst_ip").agg(F.sum("n").alias("n_half_open"), F.count("*").alias("n_sources"))
    flooded = by_target.where(F.col("n_half_open") >= least)
    return flooded.select(_naive("window.start").alias("window_start"), _naive("window.end").alias("window_end"), "dst_ip", "n_half_open", "n_sources")


def _naive(name: str) -> Column:
    return F.col(name).cast("timestamp_ntz")


def syn_rates(packets: DataFrame, window: str = "10 seconds", slide: str = "5 seconds", least: int = 100, timeout: int = TIMEOUT) -> DataFrame:
    """Destinations and windows with at least ``least`` half-open SYNs."""
    return rates(half_open(packets, timeout), window, slide, least)
