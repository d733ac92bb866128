"""Structured Streaming capture."""

from .capture import Capture, stream_packets

__all__ = ["Capture", "stream_packets"]
