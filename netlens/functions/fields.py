"""SQL text for reading integers and addresses out of a BINARY column.

``conv(hex(substring(...)))`` stays on the JVM and was the fastest of the
built-in ways measured.  Offsets are 1-based, as in SQL, and may be
expressions.  Past the end of the bytes the result is NULL; a field that would
be cut in two is the caller's business (see the length gates in
``operators.decode``).

These are texts and not Columns because a decode has some hundred of them, and
a Column costs several calls into the JVM where a text is parsed at once.
"""

from __future__ import annotations


def u8(raw: str, offset: int | str) -> str:
    """Unsigned byte at ``offset``."""
    return f"cast(conv(hex(substring({raw}, {offset}, 1)), 16, 10) as int)"


def u16(raw: str, offset: int | str) -> str:
    """Unsigned big-endian 16-bit integer at ``offset``."""
    return f"cast(conv(hex(substring({raw}, {offset}, 2)), 16, 10) as int)"


def _at(offset: int | str, by: int) -> str:
    return str(offset + by) if isinstance(offset, int) else f"{offset} + {by}"


def mac_text(raw: str, offset: int | str) -> str:
    """Six bytes as lower-case hex pairs joined by colons."""
    pairs = ", ".join(f"hex(substring({raw}, {_at(offset, i)}, 1))" for i in range(6))
    return f"lower(concat_ws(':', {pairs}))"


def ipv4_text(raw: str, offset: int | str) -> str:
    """Four bytes as a dotted quad."""
    quad = ", ".join(f"conv(hex(substring({raw}, {_at(offset, i)}, 1)), 16, 10)" for i in range(4))
    return f"concat_ws('.', {quad})"


def ipv6_text(raw: str, offset: int | str) -> str:
    """Sixteen bytes as eight lower-case groups, without ``::`` shortening.

    From base 16 to base 16 drops leading zeros and keeps a single one.
    """
    groups = ", ".join(
        f"conv(hex(substring({raw}, {_at(offset, 2 * i)}, 2)), 16, 16)" for i in range(8)
    )
    return f"lower(concat_ws(':', {groups}))"
