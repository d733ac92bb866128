"""Column functions: byte access, text rendering, names and JSON fields."""

from .names import ethertype_text, octet_text, protocol_text
from .render import ethernet_pad, ethernet_pad_hex, hex_stream, hex_to_bytes, payload_text, printable
from .text import geo_fields, is_json_object, trusted_issuer

__all__ = [
    "ethernet_pad",
    "ethernet_pad_hex",
    "ethertype_text",
    "geo_fields",
    "hex_stream",
    "hex_to_bytes",
    "is_json_object",
    "octet_text",
    "payload_text",
    "printable",
    "protocol_text",
    "trusted_issuer",
]
