"""Whole groups out of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(rows: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """True where a row's key differs from the row before (the first row is True). Nulls equal nulls."""
    n = rows.num_rows
    out = np.zeros(n, bool)
    if n:
        out[0] = True
    for k in keys:
        c = rows.column(k)
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        codes = np.asarray(c.dictionary_encode(null_encoding="encode").indices)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that never split a group, with the starts of their groups.

    The partition must be sorted by ``keys``. Only the last, still open group is held back, so memory
    follows the largest single group; callers bound that by blocks. Each row is looked at once: a batch is compared
    with the last key before it, and what is held is only put together when a group ends.
    """
    held: list[pa.RecordBatch] = []
    starts: list[np.ndarray] = []
    count = n_starts = 0
    last: tuple | None = None
    at_row = lambda b, i: tuple(b.column(k)[i].as_py() for k in keys)
    for b in batches:
        if not b.num_rows:
            continue
        new = changes(b, keys)
        new[0] = last is None or at_row(b, 0) != last
        last = at_row(b, b.num_rows - 1)
        own = np.flatnonzero(new) + count
        held.append(b)
        starts.append(own)
        count, n_starts = count + b.num_rows, n_starts + len(own)
        if count < rows or n_starts < 2:
            continue
        every, t = np.concatenate(starts), pa.Table.from_batches(held)
        cut = int(every[-1])
        yield t.slice(0, cut).combine_chunks(), every[:-1]
        held, starts, count, n_starts = t.slice(cut).to_batches(), [np.zeros(1, np.int64)], count - cut, 1
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), np.concatenate(starts)


def laid_out(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """Each key's rows in one partition, sorted by key and ``order``, for functions over Arrow batches.

    The hash is an expression of the keys: a plain repartition by the keys of a join below it would be dropped as
    redundant, and adaptive execution may then change that join and scatter its keys.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
