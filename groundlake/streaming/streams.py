"""Structured Streaming forms of the operators."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from groundlake.operators import decode
from groundlake.operators.interval_map import DAY_US, IntervalMap, valid_intervals
from groundlake.operators.late import Lateness
from groundlake.operators.redelivery import MessageArchive, packet_copies

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decoded_stream(packets: DataFrame) -> DataFrame:
    """Decoding is stateless, so the batch operator serves a stream."""
    return decode.decode(decode.from_archive(packets))


class _Days:
    """The days of one entity's map that a batch touches, as they were and as they become.

    A period lies in the day of its start. The days around an insertion are loaded too, as the last period before it
    may reach into it, and as the gaps on both sides change with it.
    """

    def __init__(self, index: list[int], load) -> None:  # noqa: ANN001
        self.index, self.old_index, self.load = list(index), list(index), load
        self.old: dict[int, tuple[list[int], list[int]]] = {}
        self.now: dict[int, tuple[list[int], list[int]]] = {}

    def _get(self, day: int) -> tuple[list[int], list[int]]:
        if day not in self.now:
            starts, ends = self.load(day)
            self.old[day] = (list(starts), list(ends))
            self.now[day] = (list(starts), list(ends))
        return self.now[day]

    def insert(self, lo: int, hi: int) -> None:
        first = max(0, bisect_left(self.index, lo // DAY_US) - 1)
        behind = bisect_left(self.index, hi // DAY_US + 1)
        days = self.index[first : behind + 1]
        own = IntervalMap([x for d in days for x in self._get(d)[0]], [x for d in days for x in self._get(d)[1]])
        own.insert(lo, hi)
        for d in days:
            self.now[d] = ([], [])
        for start, end in zip(own.starts, own.ends, strict=True):
            d = start // DAY_US
            if d not in self.now:  # a day that had no period
                self.now[d] = ([], [])
            starts, ends = self.now[d]
            starts.append(start)
            ends.append(end)
        left = sorted({*days, *(s // DAY_US for s in own.starts)})
        self.index[first : behind + 1] = [d for d in left if self.now[d][0]]

    @staticmethod
    def _gaps(index: list[int], days: dict[int, tuple[list[int], list[int]]]) -> set[tuple[int, int]]:
        """Gaps inside loaded days and between those that follow each other."""
        out, end = set(), None
        for d in index:
            if d not in days:
                end = None
                continue
            for start, stop in zip(*days[d], strict=True):
                if end is not None:
                    out.add((end, start))
                end = stop
        return out

    def changes(self) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
        """(gaps that are gone, new gaps)."""
        before, after = self._gaps(self.old_index, self.old), self._gaps(self.index, self.now)
        return before - after, after - before


class IntervalProcessor(StatefulProcessor):
    """Keeps the ordered disjoint periods of an entity in keyed state, a map entry a day with periods."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("days", "day bigint", "starts array<bigint>, ends array<bigint>")
        self.index = handle.getValueState("index", "days array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, ARG002, N802, N803
        index = [int(x) for x in self.index.get()[0]] if self.index.exists() else []
        own = _Days(index, lambda day: tuple([int(x) for x in part] for part in self.days.getValue((day,))))
        for frame in rows:
            for lo, hi in zip(frame["lo"].tolist(), frame["hi"].tolist(), strict=True):
                own.insert(lo, hi)
        for day, value in own.now.items():
            if value[0]:
                self.days.updateValue((day,), value)
            elif day in own.old:
                self.days.removeKey((day,))
        self.index.update((own.index,))
        gone, new = own.changes()
        out = [(*g, False) for g in sorted(gone)] + [(*g, True) for g in sorted(new)]
        if out:
            yield pd.DataFrame({"entity": key[0], "gap_start": [r[0] for r in out], "gap_end": [r[1] for r in out], "added": [r[2] for r in out]})

    def close(self) -> None:
        pass


def interval_stream(intervals: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, gap_start, gap_end, added): the changes of each entity's gaps by each batch.

    A row with ``added`` false takes back a gap of an earlier batch. An insertion locates the periods it overlaps by
    binary search and reads only their days and those around, so neither late intervals nor long histories make a
    batch read or emit more than it changes. Nothing is given up: the state lies in RocksDB (the session's
    state store), which is where periods without end belong.
    """
    if intervals.sparkSession.conf.get(STORE, "") != ROCKSDB:
        raise ValueError(f"set {STORE} to {ROCKSDB}")
    rows = valid_intervals(intervals, entity, start, end)
    return rows.groupBy("entity").transformWithStateInPandas(IntervalProcessor(), "entity string, gap_start bigint, gap_end bigint, added boolean", "Update", "None")


def session_periods(intervals: DataFrame, entity: str, start: str, end: str, watermark: str = "1 day") -> DataFrame:
    """(entity, period_start, period_end) by Spark's own session windows, once the watermark has passed them.

    For intervals of more than zero length; touching ones merge. Later intervals than the watermark are dropped, which
    ``interval_stream`` does not do.
    """
    rows = valid_intervals(intervals, entity, start, end).filter("hi > lo").select("entity", F.timestamp_micros("lo").alias("at"), (F.col("hi") - F.col("lo")).alias("us"))
    gap = F.concat(F.col("us").cast("string"), F.lit(" microseconds"))
    rows = rows.withWatermark("at", watermark) if rows.isStreaming else rows
    out = rows.groupBy("entity", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n_intervals"))
    return out.select("entity", F.unix_micros("w.start").alias("period_start"), F.unix_micros("w.end").alias("period_end"), "n_intervals")


def archive_sink(archive: MessageArchive):
    """``writeStream.foreachBatch(archive_sink(archive))``: each batch is merged as an incoming one; a batch that is
    delivered again only adds copies of rows the archive has, so the kept rows stay the same."""

    def merge(batch: DataFrame, batch_id: int) -> None:  # noqa: ARG001
        archive.merge(packet_copies(batch))

    return merge


def hourly_counts(events: DataFrame, entity: str, time: str, rule: Lateness = Lateness()) -> DataFrame:
    """Counts an hour of event time, corrected until the watermark passes.

    The watermark lies as far behind as the cut-off of the batch operator lies behind the end of a period.
    """
    return events.withWatermark(time, f"{(rule.cutoff - rule.period) // 1_000_000} seconds").groupBy(F.window(time, "1 hour"), entity).agg(F.count("*").alias("n")).select(entity, F.col("window.start").alias("hour"), "n")


def latest_beacons(beacons: DataFrame, state: DataFrame | None = None, by: str = "satellite_name", time: str = "received_timestamp") -> DataFrame:
    """The latest beacon of each satellite out of a batch and the table so far; for foreachBatch upserts."""
    rows = beacons if state is None else state.unionByName(beacons, allowMissingColumns=True)
    names = rows.columns
    best = rows.groupBy(by).agg(F.max_by(F.struct(*names), time).alias("_r"))
    return best.select("_r.*")
