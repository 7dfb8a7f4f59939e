"""Little-endian numbers and text out of binary columns, by native expressions or by NumPy on Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: struct codes: bytes, signed
SIZES = {"B": (1, False), "b": (1, True), "H": (2, False), "h": (2, True), "I": (4, False), "i": (4, True), "Q": (8, False)}


def number(name: str, offset: int, code: str) -> Column:
    """The number at ``offset`` of a binary column as one native expression: decimal(20,0) for Q, bigint for I, int for others."""
    size, signed = SIZES[code]
    wide = "conv(concat(" + ", ".join(f"hex(substring(`{name}`, {offset + k + 1}, 1))" for k in reversed(range(size))) + "), 16, 10)"
    if code == "Q":
        return F.expr(f"CAST({wide} AS decimal(20,0))")
    value = f"CAST({wide} AS bigint)"
    if signed:
        half = 1 << (8 * size - 1)
        value = f"(pmod({value} + {half}L, {2 * half}L) - {half}L)"
    return F.expr(value if code == "I" else f"CAST({value} AS int)")


def padded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` bytes, zero behind the end of each value."""
    column = np.arange(width)
    at = np.minimum(starts[:, None] + column, max(0, len(data) - 1))
    return np.where(column < lengths[:, None], data[at], 0).astype(np.uint8)


def numbers(rows: np.ndarray, offset: int, code: str) -> np.ndarray:
    """The same as ``number`` over padded rows."""
    size, signed = SIZES[code]
    kind = f"<{'i' if signed else 'u'}{size}"
    return np.ascontiguousarray(rows[:, offset : offset + size]).view(kind).reshape(-1)


def utf8(data: Column) -> Column:
    """Text of bytes; each malformed part becomes U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def ascii_text(data: Column) -> Column:
    """Text of bytes; each byte from 0x80 on becomes U+FFFD, trailing NULs are dropped."""
    return F.regexp_replace(F.regexp_replace(F.decode(data, "ISO-8859-1"), "[\\x80-\\xFF]", "�"), "\\x00+$", "")


def until_nul(text: Column) -> Column:
    return F.substring_index(text, "\x00", 1)


def until_last_newline(text: Column) -> Column:
    """The text before its last newline; all of it if there is none."""
    back = F.instr(F.reverse(text), "\n")
    return F.when(back > 0, F.substring(text, F.lit(1), F.length(text) - back)).otherwise(text)


def hex_bytes(text: Column) -> Column:
    """Bytes of hex text in either case with blanks between bytes; null if it isn't such text."""
    digits = F.regexp_replace(text, r"\s", "")
    return F.when(digits.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(digits))


def lower_hex(data: Column) -> Column:
    return F.lower(F.hex(data))
