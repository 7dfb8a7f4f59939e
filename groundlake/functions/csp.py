"""The 4-byte packet header."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: field, bits, from the most significant bit on
HEADER_BITS = (("csp_prio", 2), ("csp_src", 5), ("csp_dst", 5), ("csp_dport", 6), ("csp_sport", 6), ("csp_flags", 8))


def header_u32(columns: dict[str, Column] | None = None) -> Column:
    """The header as an unsigned 32-bit number in a bigint; each field is cut to its bits. Null if a field is null."""
    out, left = F.lit(0).cast("bigint"), 32
    for name, bits in HEADER_BITS:
        left -= bits
        value = (columns or {}).get(name, F.col(name)).cast("bigint").bitwiseAND((1 << bits) - 1)
        out = out.bitwiseOR(F.shiftleft(value, left))
    return out


def header_hex(columns: dict[str, Column] | None = None) -> Column:
    """The header as 8 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(header_u32(columns)), 8, "0"))
