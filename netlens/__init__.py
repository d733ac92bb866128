"""Packet analytics on Spark: decode, detect, log and enrich captured frames."""

__version__ = "0.1.0"
