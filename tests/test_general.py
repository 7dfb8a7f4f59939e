"""Problems 2 to 6 on small cases: edge values, brute force, block sizes."""

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundlake.operators import interval_map, late, rejects, spikes, timestamps
from groundlake.operators.timestamps import Rules

UTC = timezone.utc  # noqa: UP017
GOOD = "2026-01-05T00:00:12.627814Z|84a64d0003|17|Yard"


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        (GOOD, None), ("﻿" + GOOD + "\r", None), ('"2026-01-05 00:00:12+05:30"|"84 a6 4d 00 03"||"a ""b"" | c"', None), (GOOD.replace("17", ""), None), (GOOD + "\n2", None),
        (GOOD.replace("Yard", '"Yard'), "quoting"), (GOOD.replace("Yard", 'Ya"rd'), "quoting"), (GOOD.replace("Yard", '"Yard" x'), "quoting"), ('x"|', "quoting"),
        ("", "columns"), (None, "columns"), (GOOD + "|", "columns"), ("a|b|c", "columns"),
        (GOOD.replace("2026-01", "2026-13"), "timestamp"), (GOOD.replace("T00:", "T24:"), "timestamp"), (GOOD.replace("2026-01-05", "2026-02-30"), "timestamp"), (GOOD.replace("Z", "+24:00"), "timestamp"), (GOOD.replace("2026", "0000"), "timestamp"), ("|" + GOOD.split("|", 1)[1], "timestamp"),
        (GOOD.replace("84a64d0003", "84a64d000"), "payload"), (GOOD.replace("84a64d0003", "84a64d00"), "payload"), (GOOD.replace("84a64d0003", "84a64d000g"), "payload"), (GOOD.replace("84a64d0003", ""), "payload"),
        (GOOD.replace("17", "9223372036854775808"), "observation"), (GOOD.replace("17", "9223372036854775807"), None), (GOOD.replace("17", "0" * 60 + "1"), None), (GOOD.replace("17", "1 7"), "observation"), (GOOD.replace("17", "-1"), "observation"),
    ],
)
def test_line_reasons(line, reason):
    import pyarrow as pa

    assert rejects.diagnose(line) == reason
    places, columns = rejects.parse_block(pa.array([GOOD, line, GOOD], pa.string()))
    assert places.tolist() == ([0, 1, 2] if reason is None else [0, 2]) and all(len(c) == len(places) for c in columns)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='"|0aZ5 \r\n﻿é-:T.+', max_size=30), st.integers(0, 3))
def test_columnar_and_strict_paths_agree(noise, place):
    import pyarrow as pa

    fields = GOOD.split("|")
    fields[place] = noise
    line = "|".join(fields)
    assert (len(rejects.parse_block(pa.array([line]))[0]) == 1) == (rejects.diagnose(line) is None)


def test_lines_are_bisected_in_any_block_size(spark):
    rows = [(k, GOOD if k % 7 else "bad") for k in range(400)] + [(None, None)]
    df = spark.createDataFrame(rows, "line_id bigint, raw_line string").selectExpr("*", "'x' AS reason", "1 AS k")
    for size in (1, 13, 4096):
        out = rejects.parse_lines(df, block_rows=size)
        assert out.filter("reason IS NULL").count() == sum(1 for k, r in rows if r == GOOD)
        assert sorted((-1 if r.line_id is None else r.line_id, r.reason) for r in rejects.faults(out).collect()) == sorted((k if k is not None else -1, "columns") for k, r in rows if r != GOOD)
    assert rejects.parse_lines(df.limit(0)).count() == 0


def test_only_bad_lines_are_read_one_by_one(monkeypatch):
    import pyarrow as pa

    bad = [GOOD.replace("01-05", "02-30"), GOOD.replace("17", "9" * 30), GOOD + "|", "", GOOD.replace("84a6", "84a")]
    lines = [bad[k // 7 % 5] if k % 7 == 3 else GOOD for k in range(5000)]
    read, calls = [], []
    original, kernel = rejects.diagnose, rejects.isolated
    monkeypatch.setattr(rejects, "diagnose", lambda x: read.append(x) or original(x))
    monkeypatch.setattr(rejects, "isolated", lambda *a: calls.append(len(a[1])) or kernel(*a))
    out = rejects.parse_batch(pa.array(lines), 1024)
    assert len(read) == sum(x != GOOD for x in lines) and max(calls) > 500 and calls.count(1) > 100
    assert [r is None for r in out[-1].to_pylist()] == [x == GOOD for x in lines]
    assert out[1].null_count == len(read)


def ms(*a, tz=UTC):
    return int(datetime(*a, tzinfo=tz).timestamp() * 1000)


@pytest.mark.parametrize(
    ("text", "zone", "want"),
    [
        ("2024-07-04 09:30:59.480250-03:30", 0, ms(2024, 7, 4, 13, 0, 59) + 480), ("1720098539", 0, 1720098539000), ("1720098539480", 0, 1720098539480), ("1720098539480999", 0, 1720098539480),
        ("30.3.2025 04:01:16", "Europe/Berlin", ms(2025, 3, 30, 2, 1, 16)), ("2025-03-30 02:30:00", "Europe/Berlin", ms(2025, 3, 30, 1, 30)), ("2025-10-26 02:30", "Europe/Berlin", ms(2025, 10, 26, 0, 30)),
        ("2025-10-26 02:30 CET", "Europe/Berlin", ms(2025, 10, 26, 1, 30)), ("Dec 9, 2023 2:01 AMz", "Asia/Kolkata", ms(2023, 12, 9, 2, 1)), ("12 March 2022 22:49:37", 0, ms(2022, 3, 12, 22, 49, 37)),
        ("20250330T020916", 0, ms(2025, 3, 30, 2, 9, 16)), ("03/11/2024 09:15 UTC", 0, ms(2024, 11, 3, 9, 15)), ("2022/01/29 13:10:01 GMT", None, ms(2022, 1, 29, 13, 10, 1)), ("  2023-09-25 15:03:18 ", 0, ms(2023, 9, 25, 15, 3, 18)),
        ("2024-06-31T01:00:00Z", 0, None), ("02/13/2024 10:00", 0, None), ("0000-00-00 00:00:00", 0, None), ("25:10:00", 0, None), ("next pass", 0, None), ("", 0, None), (None, 0, None), ("12345", 0, None), ("2024-02-01 13:00 pm", 0, None), ("2024-02-01 10:00", None, None),
    ],
)
def test_instants(text, zone, want):
    found = timestamps.instant_readings(text, ZoneInfo(zone) if isinstance(zone, str) else zone)
    best = min(found, key=lambda r: r[2])[1] // 1000 if found else None
    assert best == want


def test_dates_and_clock():
    day = lambda t: [r[1] for r in timestamps.date_readings(t)]
    assert day("45292") == [ms(2024, 1, 1) * 1000] and day("20240704") == [ms(2024, 7, 4) * 1000]
    assert day("9-MAR-2025")[0] == ms(2025, 3, 9) * 1000 and day("32.01.2025") == [] and day(None) == []
    dates = timestamps.date_readings("2024-07-04T18:00:00")
    assert timestamps.instant_readings("10:07 am", 0, dates)[0][1] == ms(2024, 7, 4, 10, 7) * 1000
    assert timestamps.instant_readings("10:07", 0, []) == []


def test_viterbi_prefers_one_format_and_forward_time():
    rules = Rules(day_first=None)
    rows = [timestamps.instant_readings(t, 0, None, rules) for t in ("03/25/2024 10:00", "04/05/2024 10:00", "04/26/2024 10:00")]
    pick = timestamps.viterbi(rows)
    assert [rows[i][k][0] for i, k in enumerate(pick)] == ["mdy/"] * 3
    every = min(((a, b, c) for a in range(len(rows[0])) for b in range(len(rows[1])) for c in range(len(rows[2]))), key=lambda p: rows[0][p[0]][2] + timestamps._step(rows[0][p[0]], rows[1][p[1]]) + timestamps._step(rows[1][p[1]], rows[2][p[2]]))
    assert tuple(pick) == every


AGENDA = "agenda_id bigint, satellite_name string, site_zone string, mission_date string, start_utc_value string, uplink_start_dt string"


def test_the_path_decides_what_no_rule_states(spark):
    """Two-digit years at either end, and an abbreviation of several zones: each value alone has several free readings."""
    day = [datetime(2003, 4, 1) + timedelta(days=40 * k) for k in range(60)]
    rows, want = [], {}
    for k, t in enumerate(day):
        front, back = t.strftime("%y-%m-%d 10:00"), t.strftime("%d.%m.%y 10:00")
        rows += [(len(rows) + j, name, None, None, text, None) for j, (name, text) in enumerate((("front", front), ("back", back)))]
        want |= {rows[-2][0]: t.replace(hour=10), rows[-1][0]: t.replace(hour=10)}
    at = datetime(2024, 5, 1)
    for k in range(40):  # an hour apart; only +02:00 keeps the order
        at += timedelta(hours=1)
        zone = ("UTC", "IST")[k % 2]
        rows.append((len(rows), "zone", None, None, (at + timedelta(hours=2 * (k % 2))).strftime("%Y-%m-%d %H:%M ") + zone, None))
        want[rows[-1][0]] = at
    assert len(timestamps.instant_readings("03-04-05 10:00", 0)) == 2 and len(timestamps.instant_readings("2024-05-01 10:00 IST", 0)) == 3
    df = spark.createDataFrame(rows, AGENDA)
    for block in (5, 4096):
        got = {r.agenda_id: r.utc_ms for r in timestamps.normalised(df, block=block).collect()}
        assert got == {k: int(t.replace(tzinfo=UTC).timestamp() * 1000) for k, t in want.items()}


def test_blocks_don_t_change_the_path(spark):
    g = random.Random(5)
    texts = [g.choice(["%02d/%02d/2024 10:00", "%02d.%02d.2024 10:00:00"]) % (g.randint(1, 12), g.randint(1, 12)) if g.random() < 0.8 else "2024-05-06 10:00" for _ in range(400)]
    rows = [(k, g.choice(["a", None]), "UTC", None, t, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "agenda_id bigint, satellite_name string, site_zone string, mission_date string, start_utc_value string, uplink_start_dt string")
    readings = timestamps.agenda_readings(df.selectExpr("*", "1 AS us", "2 AS source", "3 AS readings"), Rules(None, None))
    cost = []
    for block in (7, 10**6):
        out = {(r.agenda_id, r.field_name): r.us for r in timestamps.choose(readings, ["source", "field_name"], "agenda_id", block).collect()}
        total = 0.0
        for source in ("a", None):
            own = [r for r in readings.collect() if r.source == source and r.field_name == "start_utc_value"]
            path = [next(tuple(x) for x in r.readings if x.us == out[r.agenda_id, r.field_name]) for r in sorted(own, key=lambda r: r.agenda_id)]
            total += path[0][2] + sum(timestamps._step(a, b) for a, b in zip(path, path[1:]))
        cost.append(total)
        assert len(out) == 800
    assert cost[0] == cost[1]
    assert timestamps.normalised(df.limit(0)).count() == 0


def test_revisions_and_cutoff(spark):
    h = ms(2026, 1, 5, 3)
    at = lambda minutes: datetime(2026, 1, 5, 3) + timedelta(minutes=minutes)
    receipts = [(1, at(30)), (2, at(70)), (3, at(70) + timedelta(microseconds=1)), (4, at(420)), (5, at(420) + timedelta(microseconds=1)), (6, at(500)), (7, at(1)), (7, at(600)), (8, None)]
    events = [(k, "s", h + 1000, 100, k) for k in range(1, 9)] + [(9, None, h, None, 1), (10, "s", None, 1, 1), (11, "s", 0, 1, 1), (12, "s", ms(2026, 1, 5, 9), 1, 1), (13, "s", h, 5, 99)]
    e = spark.createDataFrame(events, "beacon_id bigint, satellite_name string, unix_epoch_time_ms bigint, v int, packet_id bigint").selectExpr("*", "1 AS revision", "2 AS ts_received")
    p = spark.createDataFrame(receipts, "packet_id bigint, ts_received timestamp").selectExpr("*", "1 AS v")
    states = late.revisions(late.usable_events(e, p, ["satellite_name", "v"]), "satellite_name", "v")
    got = sorted((r.entity or "", r.revision, r.n_new, r.n_events, r.n_values) for r in states.collect())
    assert got == [("", 0, 1, 1, 0), ("s", 0, 3, 3, 3), ("s", 1, 1, 4, 4), ("s", 35, 1, 5, 5)]
    assert [(r.entity, r.start_us) for r in late.corrected(states).collect()] == [("s", h * 1000)]
    assert late.final(states).count() == 2
    assert late.revisions(late.usable_events(e.limit(0), p, ["satellite_name", "v"]), "satellite_name", "v").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12)), max_size=40))
def test_interval_map(spans):
    own = interval_map.IntervalMap()
    for a, n in spans:
        own.insert(a, a + n)
    want = []
    for a, z in sorted((a, a + n) for a, n in spans):
        if want and a <= want[-1][1]:
            want[-1][1] = max(want[-1][1], z)
        else:
            want.append([a, z])
    assert [list(x) for x in zip(own.starts, own.ends)] == want


def test_gaps_and_periods(spark):
    t = lambda m: None if m is None else datetime(2026, 1, 5) + timedelta(minutes=m)
    rows = [("a", 0, 10), ("a", 10, 20), ("a", 5, 6), ("a", 30, 30), ("a", 40, 2000), ("a", 50, 60), ("a", 3000, 3001), ("a", 90, 80), ("a", None, 5), ("?", 0, 1), (None, 0, 1), ("b", 5, 5), ("b", 5, 5)]
    df = spark.createDataFrame([(e, t(a), t(z)) for e, a, z in rows], "g string, s timestamp, e timestamp").selectExpr("*", "1 AS lo", "2 AS block", "3 AS entity")
    minute = 60_000_000
    base = ms(2026, 1, 5) * 1000
    for block in (minute, interval_map.DAY_US):
        got = sorted((r.entity, (r.gap_start - base) // minute, (r.gap_end - base) // minute) for r in interval_map.gaps(df, "g", "s", "e", 720 * minute, block).collect())
        assert got == [("a", 20, 30), ("a", 30, 40)]
        got = sorted((r.entity, (r.period_start - base) // minute, (r.period_end - base) // minute) for r in interval_map.periods(df, "g", "s", "e", block).collect())
        assert got == [("a", 0, 20), ("a", 30, 30), ("a", 40, 2000), ("a", 3000, 3001), ("b", 5, 5)]
    assert interval_map.gaps(df.limit(0), "g", "s", "e").count() == 0


def course(n, seed=1, scatter=20.0):
    g = np.random.default_rng(seed)
    t = np.cumsum(g.uniform(85, 118, n))
    return t, np.round(7000 + 200 * np.sin(t / 890) + g.normal(0, scatter, n))


def test_spikes_steps_and_stuck_values():
    t, y = course(900)
    assert not spikes.judge(t, y, 20.0, 5000, 9500).any()
    z = y.copy()
    z[200] += 400
    z[300:303] -= 300
    z[400:] += 500  # lasting
    z[600:608] = z[600]
    z[700] = 65535
    z[800:804] += 400  # four are a change and one back
    want = {200, 300, 301, 302, *range(600, 608), 700}
    assert set(np.flatnonzero(spikes.judge(t, z, 20.0, 5000, 9500))) == want
    t[500:] += 4000  # a contact gap with a spike at its edge
    v = y.copy()
    v[500] += 500
    assert set(np.flatnonzero(spikes.judge(t, v, 20.0, 5000, 9500))) == {500}
    assert spikes.judge(np.array([0.0]), np.array([0.0]), 0.0, 5000, 9500).tolist() == [True]


def slow_course(step, swing, seed=0):
    g = np.random.default_rng(seed)
    t = np.cumsum(g.uniform(0.85 * step, 1.18 * step, 600))
    return t, np.round(7000 + swing * np.sin(t / 890) + g.normal(0, 20, len(t)))


def test_spikes_of_slow_sources(spark):
    rows, want = [], set()
    for name, step, swing, size in (("a", 250, 200, 300), ("b", 600, 200, 800), ("c", 1500, 0, 300), ("d", 4000, 0, 300)):  # d has a reading an hour at most
        t, y = slow_course(step, swing)
        for k in range(50, 600, 50):
            y[k] += size
            want.add(len(rows) + k)
        rows += [(name, int(at * 1e6), len(rows) + k, float(v)) for k, (at, v) in enumerate(zip(t, y))]
        t, y = slow_course(step, swing, 1)  # orbit swings are no cases
        rows += [(name + "0", int(at * 1e6), len(rows) + k, float(v)) for k, (at, v) in enumerate(zip(t, y))]
    df = spark.createDataFrame(rows, "s string, event_us bigint, id bigint, v double")
    for block in (128, 4096):
        out = spikes.implausible(df, "s", "id", {"v": (0, 20_000)}, spikes.Judgement(block=block))
        assert {r.id for r in out.collect()} == want
    readings = df.selectExpr("s AS source", "'v' AS field", "event_us AS us", "id", "v AS value")
    usual = spikes.ranked(readings, {"v": (0, 20_000)}).select("source", "scatter", "interval").distinct().collect()
    assert len(usual) == 8
    for r in usual:
        t, y = (np.array([row[k] for row in rows if row[0] == r.source]) for k in (1, 3))
        share = (t[1:-1] - t[:-2]) / (t[2:] - t[:-2])
        off = np.abs(y[1:-1] - y[:-2] * (1 - share) - y[2:] * share) / np.sqrt(1 + share**2 + (1 - share) ** 2)
        assert r.scatter == pytest.approx(1.4826 * np.median(off), rel=0.02)
        assert r.interval == pytest.approx(np.median(np.diff(t)) / 1e6, rel=0.01)


def test_blocks_don_t_change_spikes(spark):
    rows = []
    for name, seed in (("a", 1), (None, 2)):
        t, y = course(700, seed)
        y[[100, 300, 301, 650]] += 700
        y[400:412] = y[400]
        rows += [(name, int(a * 1e6), k, float(v)) for k, (a, v) in enumerate(zip(t, y))]
    rows += [("c", 5, 1, None), ("a", rows[3][1], 3, rows[3][3])]
    df = spark.createDataFrame(rows, "s string, event_us bigint, id bigint, v double").selectExpr("*", "1 AS rank", "2 AS field", "3 AS source")
    found = []
    for block in (64, 4096):
        out = spikes.implausible(df, "s", "id", {"v": (5000, 9500)}, spikes.Judgement(block=block, halo=64))
        found.append(sorted((r.id, r.field_name) for r in out.collect()))
    assert found[0] == found[1] and len(found[0]) == 32
    assert spikes.implausible(df.limit(0), "s", "id", {"v": (5000, 9500)}).count() == 0
