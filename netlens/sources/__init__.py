"""Sources and sinks: packets, capture files, the log table, JDBC."""

from .jdbc import read_jdbc, write_jdbc
from .logtable import clear_logs, read_logs, stored_logs, write_logs, write_table
from .packets import append_packets, clear_buffer, merge_date, read_buffer, read_packets, stored_packets
from .paging import Cursor, end_of, log_page, packet_page, packets_since
from .pcap import read_captures, write_captures
from .pcap_source import scan_captures, stream_captures

__all__ = [
    "Cursor",
    "append_packets",
    "clear_buffer",
    "clear_logs",
    "end_of",
    "log_page",
    "merge_date",
    "packet_page",
    "packets_since",
    "read_buffer",
    "read_captures",
    "read_jdbc",
    "read_logs",
    "read_packets",
    "scan_captures",
    "stored_logs",
    "stored_packets",
    "stream_captures",
    "write_captures",
    "write_jdbc",
    "write_logs",
    "write_table",
]
