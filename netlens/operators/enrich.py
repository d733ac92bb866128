"""Enrichment of IP addresses from name, registry and geolocation tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import normal_ip
from ..functions.text import geo_fields
from ..session import stored
from .lookup import lookup_join


@dataclass(frozen=True)
class Lookups:
    """``ptr(ip, domain)``, ``whois(ip, whois)``, ``geo(ip, geo_json)``; ``ip`` in any spelling."""

    ptr: DataFrame
    whois: DataFrame
    geo: DataFrame

    def answers(self, wanted: DataFrame | None = None) -> DataFrame:
        """All three answers, one row per ``ip``, gathered in one aggregation.

        So packets meet one table per end.  Geo JSON is parsed once per address.  With
        ``wanted(ip)`` only rows of these addresses are put together.
        """
        ip = normal_ip(F.col("ip")).alias("ip")
        every = (
            self.ptr.select(ip, "domain")
            .unionByName(self.whois.select(ip, "whois"), allowMissingColumns=True)
            .unionByName(self.geo.select(ip, "geo_json"), allowMissingColumns=True)
        )
        if wanted is not None:
            every = every.join(wanted.select("ip"), "ip", "left_semi")
        info = every.filter(F.col("ip").isNotNull()).groupBy("ip").agg(
            F.min("domain").alias("domainName"), F.min("whois").alias("whoisData"), F.min("geo_json").alias("geoJson")
        )
        return info.withColumn("geoData", geo_fields(F.col("geoJson")))


def _named(info: DataFrame, prefix: str) -> DataFrame:
    return info.select("ip", *[F.col(c).alias(f"{prefix}{c}") for c in info.columns if c != "ip"])


def ip_info(ips: DataFrame, lookups: Lookups, prefix: str = "") -> DataFrame:
    """One information row per distinct ``ip`` of ``ips``."""
    info = ips.select(normal_ip(F.col("ip")).alias("ip")).filter(F.col("ip").isNotNull()).distinct()
    return info.join(_named(lookups.answers(), prefix), "ip", "left")


def _attach(df: DataFrame, ip_col: str, info: DataFrame, prefix: str, spread_by: str, options: dict) -> DataFrame:
    df = lookup_join(df, _named(info, prefix), ip_col, "ip", spread_by, **options)
    asked, answered = F.col(ip_col).isNotNull(), F.col(f"{prefix}geoData").isNotNull()
    return df.withColumn(
        f"{prefix}status", F.when(asked, F.when(answered, F.lit("ok")).otherwise(F.lit("error")))
    )


def enrich_ip(
    df: DataFrame,
    ip_col: str,
    lookups: Lookups,
    prefix: str = "",
    spread_by: str = "packet_id",
    drop_errors: bool = False,
    **options,
) -> DataFrame:
    """Add ``domainName, whoisData, geoData, geoJson, status`` for one column.

    A missing domain or registry answer is null.  A missing or malformed
    geolocation makes the request an error: ``status`` says so, or the row is
    left out with ``drop_errors``.  ``status`` is null where there is no IP.
    """
    df = _attach(df, ip_col, lookups.answers(), prefix, spread_by, options)
    return df.filter(F.col(f"{prefix}status") == "ok") if drop_errors else df


def enrich_both_ends(
    df: DataFrame,
    lookups: Lookups,
    src_col: str = "sourceip",
    dst_col: str = "destinationip",
    spread_by: str = "id",
    **options,
) -> DataFrame:
    """Enrich source and destination, prefixed ``src_`` and ``dst_``.

    The answers are gathered once, for the addresses that occur, and stored: both ends meet the
    same small table, whose size Spark then knows.
    """
    ends = df.select(F.explode(F.array(src_col, dst_col)).alias("ip")).filter(F.col("ip").isNotNull()).distinct()
    info = stored(lookups.answers(ends), "answers")
    df = _attach(df, src_col, info, "src_", spread_by, options)
    return _attach(df, dst_col, info, "dst_", spread_by, options)
