"""Timestamps in many formats and zones, brought to one UTC instant (problem 3).

Every text yields an array of all its valid readings (format, instant, cost). For each source the readings of its
records, in record order, form a lattice, and Viterbi picks the cheapest path: a switch of format and a jump back
in time cost something, and so does a reading that a stated rule speaks against. Rule costs outweigh any path
cost, so a rule decides wherever one is stated and the path decides the rest: whether a date with a two-digit year
ends or begins with it, and which zone an abbreviation of several means.

The lattice is cut into blocks of the order column. A block is reduced to a small cost matrix between the readings
of its first and last row, beside the choices of its rows for each pair of these; the matrices of a source are chained
over one summary row a block, which picks the pair. The result equals one Viterbi run over the whole source, no task
holds a source, and each text is parsed once. Between two rows with one reading each the path is settled, so Viterbi
only runs over rows with several readings and their neighbours.

Defined results: null, empty or unreadable text gives no row; rows with a null source form one source; rows of
equal order keep any order among themselves and each gets its result; extra columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundlake.functions.batches import laid_out, whole_groups
from groundlake.session import written

SWITCH, BACKWARD, AGAINST_RULE = 1.0, 1.0, 1e6
LESS_USUAL = 0.5  # of a zone abbreviation's other meanings; less than one switch or jump
_EPOCH = datetime(1970, 1, 1)
_US = timedelta(microseconds=1)

#: fixed values: zone abbreviations and their offsets in minutes
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "AWST": 480, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
#: fixed values: other meanings of such abbreviations, in minutes
MORE_ZONES = {"IST": (120, 60), "CST": (480, -300), "BST": (360,), "AST": (180,), "ADT": (240,), "GST": (-120,), "ECT": (-240,), "AMT": (240,), "SST": (480,), "PST": (480,), "WST": (780,), "EST": (600,)}
MONTHS = {m[:k].lower(): i for i, m in enumerate("January February March April May June July August September October November December".split(), 1) for k in {3, len(m)}} | {"sept": 9}

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp]\.?[Mm]\.?))?"
_ZONE = r"(?:\s*(?P<z>[Zz]|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}|[A-Za-z]+/[A-Za-z_/]+))?"
_REST = rf"(?:(?:\s*,)?(?:\s+|[Tt]){_TIME}{_ZONE})?"
_FORMS = [
    (name, re.compile(rf"{day}{_REST}\Z", re.ASCII))
    for name, day in (
        ("ymd", r"(?P<y>\d{4})(?P<sep>[-/.])(?P<a>\d{1,2})(?P=sep)(?P<b>\d{1,2})"),
        ("two", r"(?P<a>\d{2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<y>\d{2})(?!\d)"),
        ("end", r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<y>\d{4})"),
        ("dmon", r"(?P<a>\d{1,2})(?:\s+|-|\.\s*)(?P<mon>[A-Za-z]{3,9})\.?(?:\s+|-|,\s*)(?P<y>\d{4})"),
        ("mond", r"(?P<mon>[A-Za-z]{3,9})\.?\s+(?P<a>\d{1,2}),?\s+(?P<y>\d{4})"),
        ("ymon", r"(?P<y>\d{4})[-\s](?P<mon>[A-Za-z]{3,9})[-\s](?P<a>\d{1,2})"),
    )
]
_COMPACT = re.compile(rf"(?P<y>\d{{4}})(?P<a>\d\d)(?P<b>\d\d)(?:[Tt ](?P<h>\d\d)(?P<mi>\d\d)(?:(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?(?P<ap>){_ZONE})?\Z", re.ASCII)
_CLOCK = re.compile(rf"{_TIME}{_ZONE}\Z", re.ASCII)
_NUMBER = re.compile(r"\d+\Z", re.ASCII)

Reading = tuple[str, int, float]


@dataclass(frozen=True)
class Rules:
    """What is stated about the texts; None leaves the matter to the path."""

    day_first: bool | None = True
    first_of_repeated: bool | None = True


@lru_cache(maxsize=512)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


@lru_cache(maxsize=4096)
def _offsets(text: str | None) -> tuple[int | ZoneInfo, ...] | None:
    """What a zone's text can mean, in minutes or as a zone, the usual first; empty if none is stated, None if it is no zone."""
    if not text:
        return ()
    if text[0] in "+-":
        digits = text[1:].replace(":", "")
        h, m = int(digits[:2]), int(digits[2:] or 0)
        return ((h * 60 + m) * (-1 if text[0] == "-" else 1),) if h < 24 and m < 60 else None
    if text.upper() in ZONES:
        return (ZONES[text.upper()], *MORE_ZONES.get(text.upper(), ()))
    zone = _zone(text) if "/" in text else None
    return None if zone is None else (zone,)


def _clock(m: re.Match) -> int | None:
    """Microseconds of the day; -1 if no time of day is given, None if it is impossible."""
    if m["h"] is None:
        return -1
    h, mi, s = int(m["h"]), int(m["mi"]), int(m["s"] or 0)
    if m["ap"]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if m["ap"][0] in "Pp" else 0)
    if h > 23 or mi > 59 or s > 59:
        return None
    return ((h * 60 + mi) * 60 + s) * 1_000_000 + int((m["f"] or "")[:6].ljust(6, "0"))


def _day(y: int, m: int, d: int) -> int | None:
    """Days since 1970."""
    try:
        return date(y, m, d).toordinal() - 719163
    except ValueError:
        return None


def _century(y: int) -> int:
    return y + (1900 if y >= 70 else 2000)


def _days(text: str, rules: Rules) -> Iterator[tuple[str, int, float, re.Match | None]]:
    """Readings of the date part: (format, day, cost, match with the rest)."""
    if _NUMBER.match(text) and len(text) != 8:
        n = int(text) if len(text) in (5, 10, 13, 16) else None
        if n is not None and len(text) == 5:
            yield "serial", n - 25569, 0.0, None
        elif n is not None:
            yield "epoch", n // (86400 * 1000 ** ((len(text) - 10) // 3)), 0.0, None
        return
    if m := _COMPACT.match(text):
        if (d := _day(int(m["y"]), int(m["a"]), int(m["b"]))) is not None:
            yield "compact", d, 0.0, m
        return
    for name, form in _FORMS:
        if not (m := form.match(text)):
            continue
        y, a = int(m["y"]), int(m["a"])
        if name == "two":  # the year may stand at either end; nothing is stated about it
            b = int(m["b"])
            for tag, days in (("dmy2", _day(_century(y), b, a)), ("ymd2", _day(_century(a), b, y))):
                if days is not None:
                    yield tag + m["sep"], days, 0.0, m
            return
        if name == "ymd":
            if (d := _day(y, a, int(m["b"]))) is not None:
                yield name + m["sep"], d, 0.0, m
        elif name == "end":
            b = int(m["b"])
            first, second = _day(y, b, a), _day(y, a, b)
            if rules.day_first is False:
                first, second = second, first
            tags = ("mdy", "dmy") if rules.day_first is False else ("dmy", "mdy")
            if first is not None:
                yield tags[0] + m["sep"], first, 0.0, m
            if second is not None and second != first and (rules.day_first is None or first is not None):
                yield tags[1] + m["sep"], second, 0.0 if rules.day_first is None else AGAINST_RULE, m
        elif m["mon"].lower() in MONTHS and (d := _day(y, MONTHS[m["mon"].lower()], a)) is not None:
            yield name, d, 0.0, m
        return


def _instants(local_us: int, zone: int | ZoneInfo, rules: Rules) -> list[tuple[int, float]]:
    """UTC instants a local time can mean. A skipped time moves forward by the gap."""
    if isinstance(zone, int):
        return [(local_us - zone * 60_000_000, 0.0)]
    try:
        at = _EPOCH + timedelta(microseconds=local_us)
        one, two = (at.replace(tzinfo=zone, fold=k).utcoffset() // _US for k in (0, 1))
    except (OverflowError, ValueError):
        return []
    if one <= two:  # usual, or skipped: the offset before the change
        return [(local_us - one, 0.0)]
    first = rules.first_of_repeated
    return [(local_us - one, AGAINST_RULE if first is False else 0.0), (local_us - two, AGAINST_RULE if first else 0.0)]


def date_readings(text: str | None, rules: Rules = Rules()) -> list[Reading]:
    """Readings as a date: midnight UTC; a time of day is ignored but must be possible."""
    out = []
    for name, day, cost, m in _days((text or "").strip(), rules):
        if m is None or (_clock(m) is not None and _offsets(m["z"]) is not None):
            out.append((name, day * 86_400_000_000, cost))
    return out


def instant_readings(text: str | None, zone: int | ZoneInfo | None, dates: list[Reading] | None = None, rules: Rules = Rules()) -> list[Reading]:
    """Readings as an instant. ``zone``: of texts without one, None if unknown; ``dates``: for a time of day alone."""
    text = (text or "").strip()
    if _NUMBER.match(text) and len(text) != 8:
        return [("epoch%d" % len(text), int(text) * 10 ** (16 - len(text)), 0.0)] if len(text) in (10, 13, 16) else []
    out: list[Reading] = []
    seen: set[tuple[str, int]] = set()

    def add(name: str, local_us: int, said: tuple[int | ZoneInfo, ...], cost: float) -> None:
        for k, used in enumerate(said):
            tag = name if len(said) == 1 else f"{name}@{used}"
            for us, more in _instants(local_us, used, rules):
                if (tag, us) not in seen:
                    seen.add((tag, us))
                    out.append((tag, us, cost + more + (LESS_USUAL if k else 0.0)))

    if dates is not None and (m := _CLOCK.match(text)):
        clock, said = _clock(m), _offsets(m["z"])
        if clock is not None and said is not None:
            for _, day, cost in dates:
                add("clock", day + clock, said or (0,), cost)
        return out
    for name, day, cost, m in _days(text, rules):
        if m is None or (clock := _clock(m)) is None or (said := _offsets(m["z"])) is None:
            continue
        if said or zone is not None:
            add(name, day * 86_400_000_000 + max(clock, 0), said or (zone,), cost)
    return out


def _step(a: Reading, b: Reading) -> float:
    return b[2] + (SWITCH if a[0] != b[0] else 0.0) + (BACKWARD if b[1] < a[1] else 0.0)


def _forward(rows: list[list[Reading]], first: int) -> tuple[list[float], list[list[int]]]:
    """Costs of the last row's readings when the first row takes reading ``first``, and the way back."""
    cost = [rows[0][k][2] if k == first else float("inf") for k in range(len(rows[0]))]
    back: list[list[int]] = [[0] * len(rows[0])]
    for before, now in zip(rows, rows[1:]):
        new, ways = [], []
        for b in now:
            best = min(range(len(before)), key=lambda k: cost[k] + _step(before[k], b))
            new.append(cost[best] + _step(before[best], b))
            ways.append(best)
        cost, back = new, [*back, ways]
    return cost, back


def viterbi(rows: list[list[Reading]], first: int | None = None, last: int | None = None) -> list[int]:
    """The cheapest choice of one reading a row; the ends may be fixed."""
    if not rows:
        return []
    starts = range(len(rows[0])) if first is None else [first]
    runs = [_forward(rows, k) for k in starts]
    costs, back = min(runs, key=lambda r: min(r[0]) if last is None else r[0][last])
    at = min(range(len(costs)), key=costs.__getitem__) if last is None else last
    out = [at]
    for ways in reversed(back[1:]):
        at = ways[at]
        out.append(at)
    return out[::-1]


_READING = pa.struct([("form", pa.string()), ("us", pa.int64()), ("cost", pa.float64())])
_READINGS_SQL = "array<struct<form:string,us:bigint,cost:double>>"


def _solve(sizes: np.ndarray, first: np.ndarray, rows: Callable[[int, int], list[list[Reading]]]) -> tuple[list[list[float]], np.ndarray]:
    """(costs between the readings of the first and last row up to a constant, chosen instants by pair and row).

    ``sizes``: readings a row; ``first``: the instant of a row's first reading; ``rows(a, z)``: readings of rows a..z.
    """
    n, single = len(sizes), np.flatnonzero(sizes == 1)
    heads, tails = int(sizes[0]), int(sizes[-1])
    picks = np.tile(first, (heads * tails, 1))

    def put(where: list[int], a: int, own: list[list[Reading]], chosen: list[int]) -> None:
        for k in where:
            picks[k, a : a + len(own)] = [row[i][1] for row, i in zip(own, chosen, strict=True)]

    if not len(single):
        own = rows(0, n - 1)
        matrix = [_forward(own, i)[0] for i in range(heads)]
        for i in range(heads):
            for j in range(tails):
                put([i * tails + j], 0, own, viterbi(own, i, j))
        return matrix, picks
    every = list(range(heads * tails))
    for a, z in zip(single[:-1], single[1:]):
        if z - a > 1:
            own = rows(int(a), int(z))
            put(every, int(a), own, viterbi(own))
    head_cost, tail_cost = [0.0] * heads, [0.0] * tails
    if single[0] > 0:
        own = rows(0, int(single[0]))
        for i in range(heads):
            head_cost[i] = _forward(own, i)[0][0]
            put([i * tails + j for j in range(tails)], 0, own, viterbi(own, i))
    if single[-1] < n - 1:
        own = rows(int(single[-1]), n - 1)
        tail_cost = _forward(own, 0)[0]
        for j in range(tails):
            put([i * tails + j for i in range(heads)], int(single[-1]), own, viterbi(own, 0, j))
    return [[a + z for z in tail_cost] for a in head_cost], picks


def _chain(group: list[dict]) -> Iterator[tuple[int, int]]:
    """The first and last reading of every block of a chain."""
    firsts, lasts, matrices = ([g[k] for g in group] for k in ("head", "tail", "matrix"))
    best = [[min(m[i][j] for i in range(len(m))) for j in range(len(m[0]))] for m in matrices[:1]]
    enter: list[list[int]] = [[min(range(len(matrices[0])), key=lambda i, j=j: matrices[0][i][j]) for j in range(len(matrices[0][0]))]]
    came: list[list[int]] = [[]]
    for k in range(1, len(group)):
        m, row_in, row_came, row_best = matrices[k], [], [], []
        # matrix entries hold the first row's own cost already, so the step into it must not add it again
        into = []
        for i, b in enumerate(firsts[k]):
            way = min(range(len(lasts[k - 1])), key=lambda p, b=b: best[-1][p] + _step(lasts[k - 1][p], b))
            into.append((best[-1][way] + _step(lasts[k - 1][way], b) - b[2], way))
        for j in range(len(m[0])):
            i = min(range(len(m)), key=lambda i, j=j: into[i][0] + m[i][j])
            row_in.append(i)
            row_came.append(into[i][1])
            row_best.append(into[i][0] + m[i][j])
        best.append(row_best)
        enter.append(row_in)
        came.append(row_came)
    at = min(range(len(best[-1])), key=best[-1].__getitem__)
    out = []
    for k in range(len(group) - 1, -1, -1):
        out.append((enter[k][at], at))
        if k:
            at = came[k][at]
    yield from reversed(out)


def choose(readings: DataFrame, source: list[str], order: str, block: int = 4096) -> DataFrame:
    """Adds ``us``, the chosen instant, to rows with ``readings``; rows without a reading are left out.

    ``block``: width of a block in values of the integer column ``order``.
    """
    rows = readings.filter(F.size("readings") > 0).withColumn("_block", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    key = [*source, "_block"]
    kept = [c for c in rows.columns if c not in ("readings", "_block")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    typed = lambda names: ", ".join(f"`{c}` {kinds[c]}" for c in names)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, key):
            column = t.column("readings").combine_chunks()
            offsets, values = column.offsets.to_numpy(), column.values
            instants, sizes = values.field("us").to_numpy(zero_copy_only=False), np.diff(offsets)
            ends = np.append(starts[1:], t.num_rows)
            matrices, chosen, pairs = [], [], []
            for a, z in zip(starts, ends, strict=True):
                def own(p: int, q: int, a: int = int(a)) -> list[list[Reading]]:
                    return [[(r["form"], r["us"], r["cost"]) for r in row] for row in column.slice(a + p, q - p + 1).to_pylist()]

                matrix, picks = _solve(sizes[a:z], instants[offsets[a:z]], own)
                matrices.append(matrix)
                chosen.append(picks.T.reshape(-1))  # by row, then by pair
                pairs.append(np.full(int(z - a), len(picks)))
            at, last = pa.array(np.asarray(starts)), pa.array(ends - 1)
            us = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(pairs))), pa.int32()), pa.array(np.concatenate(chosen)))
            items = pa.StructArray.from_arrays([*[t.column(c).combine_chunks() for c in kept], us], [*kept, "us"])
            items = pa.ListArray.from_arrays(pa.array(np.append(starts, t.num_rows), pa.int32()), items)
            columns = [t.column(k).combine_chunks().take(at) for k in key] + [column.take(at), column.take(last), pa.array(matrices, pa.list_(pa.list_(pa.float64()))), items]
            yield pa.RecordBatch.from_arrays(columns, [*key, "head", "tail", "matrix", "items"])

    item = "struct<" + ",".join(f"`{c}`:{kinds[c]}" for c in kept) + ",us:array<bigint>>"
    blocks = laid_out(rows, key, order).mapInArrow(solved, f"{typed(key)}, head {_READINGS_SQL}, tail {_READINGS_SQL}, matrix array<array<double>>, items array<{item}>")
    blocks = written(blocks, "blocks")

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams the summaries and holds one chain of blocks at a time."""
        held: list[dict] = []
        out: list[tuple] = []

        def flush() -> None:
            for g, ends in zip(held, _chain(held) if held else (), strict=True):
                out.append((*(g[k] for k in key), *ends))
            held.clear()

        for b in batches:
            for g in b.to_pylist():
                for k in ("head", "tail"):
                    g[k] = [(r["form"], r["us"], r["cost"]) for r in g[k]]
                # with single readings on both sides of a boundary, neither side can sway the other
                if held and (any(held[-1][k] != g[k] for k in source) or len(g["head"]) == len(held[-1]["tail"]) == 1):
                    flush()
                held.append(g)
            if out:
                yield batch(out)
                out.clear()
        flush()
        if out:
            yield batch(out)

    arrow = {k: {"bigint": pa.int64(), "int": pa.int32()}.get(kinds[k], pa.string()) for k in key}

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(cols, key)] + [pa.array(c, pa.int32()) for c in cols[len(key) :]], [*key, "_first", "_last"])

    summary = blocks.select(*key, "head", "tail", "matrix")
    ends = laid_out(summary, source, "_block").mapInArrow(chains, f"{typed(key)}, _first int, _last int").filter("_first > 0 OR _last > 0")
    x, e = blocks.alias("x"), ends.alias("e")
    found = x.join(e, [F.col(f"x.{k}").eqNullSafe(F.col(f"e.{k}")) for k in key], "left")
    at = F.coalesce(F.col("e._first") * F.size("x.tail") + F.col("e._last"), F.lit(0)) + 1
    return found.select(at.alias("_at"), F.explode("x.items").alias("_i")).select(*[F.col("_i")[c].alias(c) for c in kept], F.element_at(F.col("_i.us"), F.col("_at")).alias("us"))


def _readings(found: list[list[Reading]]) -> pa.ListArray:
    flat = [r for row in found for r in row]
    form, us, cost = zip(*flat, strict=True) if flat else ((), (), ())
    values = pa.StructArray.from_arrays([pa.array(form, pa.string()), pa.array(us, pa.int64()), pa.array(cost, pa.float64())], fields=list(_READING))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(row) for row in found])), pa.int32()), values)


def agenda_readings(agenda: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(agenda_id, source, field_name, readings) of the three time fields of agenda; source is the satellite."""
    rows = agenda.select("agenda_id", F.col("satellite_name").cast("string").alias("source"), "site_zone", "mission_date", "start_utc_value", "uplink_start_dt")
    kind = rows.schema["agenda_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sources, zones, dates, starts, uplinks = (c.to_pylist() for c in b.columns)
            found = []
            for zone, day, start, uplink in zip(zones, dates, starts, uplinks, strict=True):
                days = date_readings(day, rules)
                found += [days, instant_readings(start, 0, days, rules), instant_readings(uplink, _zone(zone) if zone else None, None, rules)]
            n = b.num_rows
            thrice = [i for i in range(n) for _ in range(3)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(thrice, pa.int32())), b.column(1).take(pa.array(thrice, pa.int32())), pa.array(["mission_date", "start_utc_value", "uplink_start_dt"] * n, pa.string()), _readings(found)],
                ["agenda_id", "source", "field_name", "readings"],
            )

    return rows.mapInArrow(run, f"agenda_id {kind}, source string, field_name string, readings {_READINGS_SQL}")


def normalised(agenda: DataFrame, rules: Rules = Rules(), block: int = 4096) -> DataFrame:
    """(agenda_id, field_name, utc_ms): one row for each time field that denotes a time."""
    chosen = choose(agenda_readings(agenda, rules), ["source", "field_name"], "agenda_id", block)
    return chosen.select("agenda_id", "field_name", F.floor(F.col("us") / F.lit(1000)).cast("bigint").alias("utc_ms"))


__all__ = ["Rules", "agenda_readings", "choose", "date_readings", "instant_readings", "normalised", "viterbi"]
