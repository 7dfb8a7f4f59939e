"""Overlapping and gapped intervals (problem 5).

``IntervalMap`` is the keyed state: disjoint closed periods in order. An insertion finds the overlapped periods by
binary search, merges them and so updates the gaps between them. The batch operator keeps one map for each entity
and time block, so that no entity, however hot, is one task; a running maximum of the block ends (one row a block)
tells each block how far the periods before it reach, and the gaps and periods follow exactly.
``streaming.interval_stream`` keeps the same map in streaming state.

Defined results: rows with a null entity or time, with an excluded entity, or with end before start are left out;
touching intervals merge; an interval of zero length is a period if it stands alone; repeated rows change nothing;
extra columns are not carried; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundlake.functions.batches import laid_out, whole_groups

DAY_US = 86_400_000_000


class IntervalMap:
    """Ordered disjoint closed periods: ``starts[i] <= ends[i] < starts[i + 1]``."""

    __slots__ = ("ends", "starts")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.starts, self.ends = starts or [], ends or []

    def insert(self, start: int, end: int) -> None:
        """O(log n) to locate, and the merged periods are replaced by one."""
        a = bisect_left(self.ends, start)  # the first period that ends at or after the start
        z = bisect_right(self.starts, end)  # behind the last period that starts at or before the end
        if a < z:
            start, end = min(start, self.starts[a]), max(end, self.ends[z - 1])
        self.starts[a:z] = [start]
        self.ends[a:z] = [end]

    def gaps(self) -> Iterator[tuple[int, int]]:
        yield from zip(self.ends, self.starts[1:])


def valid_intervals(df: DataFrame, entity: str, start: str, end: str, excluded: tuple[str, ...] = ("?",)) -> DataFrame:
    """(entity, lo, hi) in epoch microseconds."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    out = df.select(F.col(entity).cast("string").alias("entity"), micros(start).alias("lo"), micros(end).alias("hi"))
    return out.filter(F.col("entity").isNotNull() & ~F.col("entity").isin(*excluded) & (F.col("lo") <= F.col("hi")))


def _block(c: Column, width: int) -> Column:
    return F.floor(c / F.lit(width)).cast("bigint")


def block_periods(intervals: DataFrame, block_us: int = DAY_US) -> DataFrame:
    """(entity, block, lo, hi): the map of each entity and block of interval starts."""
    key = ["entity", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, key):
            lo, hi = t.column("lo").to_pylist(), t.column("hi").to_pylist()
            at, a_out, z_out = [], [], []
            for a, z in zip(starts, [*starts[1:], t.num_rows], strict=True):
                state = IntervalMap()
                for i in range(a, z):
                    state.insert(lo[i], hi[i])
                at += [int(a)] * len(state.starts)
                a_out += state.starts
                z_out += state.ends
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(t.column(k).combine_chunks().take(take) for k in key), pa.array(a_out, pa.int64()), pa.array(z_out, pa.int64())], [*key, "lo", "hi"])

    laid = laid_out(intervals.select("entity", _block(F.col("lo"), block_us).alias("block"), "lo", "hi"), key)
    return laid.mapInArrow(run, "entity string, block bigint, lo bigint, hi bigint")


def joined_periods(blocks: DataFrame) -> DataFrame:
    """(entity, block, lo, hi, reach): block periods with how far anything before them in the entity reaches.

    ``reach`` is null for the first period of an entity; a gap lies before a period if ``lo > reach``.
    """
    spans = blocks.groupBy("entity", "block").agg(F.max("hi").alias("_hi"))
    before = F.max("_hi").over(W.partitionBy("entity").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    carried = blocks.join(spans.select("entity", "block", before.alias("_reach")), ["entity", "block"])
    inside = F.max("hi").over(W.partitionBy("entity", "block").orderBy("lo").rowsBetween(W.unboundedPreceding, -1))
    return carried.select("entity", "block", "lo", "hi", F.greatest("_reach", inside).alias("reach"))


def gaps(df: DataFrame, entity: str, start: str, end: str, longest_us: int | None = None, block_us: int = DAY_US) -> DataFrame:
    """(entity, gap_start, gap_end) in epoch microseconds, of more than 0 and at most ``longest_us``."""
    found = joined_periods(block_periods(valid_intervals(df, entity, start, end), block_us))
    found = found.filter("lo > reach")
    if longest_us is not None:
        found = found.filter(F.col("lo") - F.col("reach") <= longest_us)
    return found.select("entity", F.col("reach").alias("gap_start"), F.col("lo").alias("gap_end"))


def periods(df: DataFrame, entity: str, start: str, end: str, block_us: int = DAY_US) -> DataFrame:
    """(entity, period_start, period_end): the merged continuous periods.

    A block keeps its own periods; only one row a block and entity is chained to carry a period's start across
    blocks without a gap.
    """
    rows = joined_periods(block_periods(valid_intervals(df, entity, start, end), block_us))
    rows = rows.withColumn("_new", F.coalesce(F.col("lo") > F.col("reach"), F.lit(True)))
    in_block = W.partitionBy("entity", "block").orderBy("lo")
    rows = rows.withColumn("_start", F.last(F.when(F.col("_new"), F.col("lo")), ignorenulls=True).over(in_block.rowsBetween(W.unboundedPreceding, 0)))
    edge = rows.groupBy("entity", "block").agg(F.max("_start").alias("_last"))
    prior = F.last("_last", ignorenulls=True).over(W.partitionBy("entity").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.join(edge.select("entity", "block", prior.alias("_prior")), ["entity", "block"])
    return rows.groupBy("entity", F.coalesce("_start", "_prior").alias("period_start")).agg(F.max("hi").alias("period_end"))
