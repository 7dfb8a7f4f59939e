import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundlake.operators.interval_map import DAY_US, IntervalMap
from groundlake.streaming import streams

BASE = int((datetime(2026, 1, 5) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
SCHEMA = "g string, s timestamp, e timestamp"


def at(minutes):
    return datetime(2026, 1, 5) + timedelta(minutes=minutes)


def test_interval_stream_tells_the_changes_of_gaps(spark, tmp_path):
    source, found = str(tmp_path / "in"), []
    batches = [
        ([("a", 0, 10), ("a", 30, 40), ("?", 0, 1), ("b", 5, 6)], {("a", 10, 30, True)}),
        ([("a", 20, 35), ("a", 90_000, 90_010)], {("a", 10, 30, False), ("a", 10, 20, True), ("a", 40, 90_000, True)}),  # 62 days later
        ([("a", 5, 50), ("b", 1, 2)], {("a", 10, 20, False), ("a", 40, 90_000, False), ("a", 50, 90_000, True), ("b", 2, 5, True)}),  # late
        ([("a", 10, 12)], set()),
    ]
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    out = streams.interval_stream(spark.readStream.schema(SCHEMA).parquet(source), "g", "s", "e")
    for rows, want in batches:
        spark.createDataFrame([(g, at(s), at(e)) for g, s, e in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        found.clear()
        query = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda b, _: found.extend(b.collect()))
        query.start().awaitTermination(120)
        assert {(r.entity, (r.gap_start - BASE) // 60_000_000, (r.gap_end - BASE) // 60_000_000, r.added) for r in found} == want and len(found) == len(want)


def test_interval_stream_needs_its_state_store(spark):
    df = spark.readStream.format("rate").load().selectExpr("'a' AS g", "timestamp AS s", "timestamp AS e")
    spark.conf.set(streams.STORE, "another")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            streams.interval_stream(df, "g", "s", "e")
    finally:
        spark.conf.set(streams.STORE, streams.ROCKSDB)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 400)), max_size=30), st.integers(1, 6))
def test_days_of_state_equal_one_map(spans, batch):
    unit, store, index, whole, gaps = DAY_US // 24, {}, [], IntervalMap(), set()
    for k in range(0, len(spans), batch):
        days = streams._Days(index, store.__getitem__)
        for a, n in spans[k : k + batch]:
            days.insert(a * unit, (a + n) * unit)
            whole.insert(a * unit, (a + n) * unit)
        gone, new = days.changes()
        assert gone <= gaps and not new & gaps
        gaps = gaps - gone | new
        store |= {d: v for d, v in days.now.items() if v[0]}
        for d in [d for d, v in days.now.items() if not v[0]]:
            store.pop(d, None)
        index = days.index
        assert index == sorted(store) and gaps == set(whole.gaps())
    assert [x for d in index for x in store[d][0]] == whole.starts


def test_session_periods(spark):
    g = random.Random(1)
    rows = [("ab"[k % 2], at(s), at(s + g.randint(1, 30))) for k in range(200) for s in [g.randint(0, 3000)]]
    want = {}
    for e, s, z in rows:
        want.setdefault(e, IntervalMap()).insert(*(int((x - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 for x in (s, z)))
    got = streams.session_periods(spark.createDataFrame(rows, SCHEMA), "g", "s", "e").collect()
    assert sorted((r.entity, r.period_start, r.period_end) for r in got) == sorted((e, a, z) for e, m in want.items() for a, z in zip(m.starts, m.ends))


def test_latest_beacons(spark):
    a = spark.createDataFrame([("x", 1, "p"), ("x", 3, "q"), ("y", 2, "r")], "satellite_name string, received_timestamp int, v string")
    b = streams.latest_beacons(a)
    again = streams.latest_beacons(a.filter("false"), b)
    assert sorted((r.satellite_name, r.v) for r in again.collect()) == [("x", "q"), ("y", "r")]
