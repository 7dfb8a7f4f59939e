"""CRC-32C (Castagnoli) over binary columns, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLYNOMIAL = 0x82F63B78  # fixed value: the reflected Castagnoli polynomial


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


TABLE = _table()


def crc32c_rows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Register (not yet complemented) after bytes ``data[starts[i]:ends[i]]`` of every row.

    Rows are ordered by length, so each step handles a prefix of rows without masks.
    """
    n = len(starts)
    crc = np.full(n, 0xFFFFFFFF, np.uint32) if state is None else state.astype(np.uint32)
    length = np.maximum(ends - starts, 0)
    order = np.argsort(-length, kind="stable")
    sorted_len, at, reg = length[order], starts[order], crc[order]
    longest = int(sorted_len[0]) if n else 0
    active = np.searchsorted(-sorted_len, -np.arange(longest), side="left")
    for j in range(longest):
        k = active[j]
        reg[:k] = TABLE[(reg[:k] ^ data[at[:k] + j]) & 0xFF] ^ (reg[:k] >> np.uint32(8))
    out = np.empty(n, np.uint32)
    out[order] = reg
    return out


def _buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    arr = arr.cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(1, np.uint8)), offsets


def _valid(arr: pa.Array) -> np.ndarray:
    return np.asarray(arr.is_valid().to_numpy(zero_copy_only=False), bool)


@F.arrow_udf(T.LongType())
def _crc32c(content: pa.Array) -> pa.Array:
    data, off = _buffers(content)
    return pa.array((crc32c_rows(data, off[:-1], off[1:]) ^ np.uint32(0xFFFFFFFF)).astype(np.int64), mask=~_valid(content))


@F.arrow_udf(T.BooleanType())
def _trailer_valid(header: pa.Array, payload: pa.Array) -> pa.Array:
    ok = _valid(header) & _valid(payload)
    head = np.asarray(header.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    data, off = _buffers(payload)
    start, end = off[:-1], off[1:]
    ok &= end - start >= 4
    be = np.empty((len(head), 4), np.uint8)
    for k in range(4):
        be[:, k] = (head >> (24 - 8 * k)) & 0xFF
    four = np.arange(0, 4 * len(head), 4)
    state = crc32c_rows(be.reshape(-1), four, four + 4)
    body_end = np.where(ok, end - 4, start)
    crc = crc32c_rows(data, start, body_end, state) ^ np.uint32(0xFFFFFFFF)
    at = np.where(ok, end - 4, 0)
    said = np.zeros(len(head), np.uint32)
    last = len(data) - 1
    for k in range(4):
        said = (said << np.uint32(8)) | data[np.minimum(at + k, last)].astype(np.uint32)
    return pa.array(ok & (crc == said))


def crc32c(content: Column) -> Column:
    """CRC-32C of a binary column as bigint; null for null."""
    return _crc32c(content)


def trailer_valid(header_u32: Column, payload: Column) -> Column:
    """Does ``payload`` end with the big-endian CRC-32C of the 4-byte header and all bytes before the trailer?

    False for a null header, a null payload and for fewer than 4 bytes.
    """
    return _trailer_valid(header_u32, payload)
