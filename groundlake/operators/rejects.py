"""Lines that fail to parse (problem 2).

Blocks of lines are parsed by columnar Arrow kernels, stage by stage: quoting and columns, timestamp, payload,
observation. A kernel that tells which values it refuses places the bad lines itself. One that only fails as a whole
(an impossible date, a number beyond bigint) fails the block, which is then bisected, at that stage, down to the
single bad lines. The other lines of the block go on to the next stage, so a bad line costs its neighbours nothing, and
only bad lines are read character by character, to name the first reason that applies.

Reasons, in order: ``quoting``, ``columns``, ``timestamp``, ``payload``, ``observation``. Defined results: a null
line has no fields and is a ``columns`` fault, so is an empty line; a leading byte-order mark and one trailing CR
are ignored; blanks in the payload are spaces and tabs; columns of the input other than the key and the line are
not carried.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM = "﻿"
LEAST_BYTES = 5
_FIELD = r'("(?:[^"]|"")*"|[^"|]*)'
#: RE2, for the columnar path; (?s) lets fields hold line breaks
_ROW = rf"(?s)^\x{{FEFF}}?(?P<a>{_FIELD[1:-1]})\|(?P<b>{_FIELD[1:-1]})\|(?P<c>{_FIELD[1:-1]})\|(?P<d>{_FIELD[1:-1]})$"
_TIME = r"^(?P<day>[0-9]{4}-[0-9]{2}-[0-9]{2})[T ](?P<h>[0-9]{2}):(?P<m>[0-9]{2}):(?P<s>[0-9]{2})(?:\.(?P<f>[0-9]+))?(?P<z>Z|[+-][0-9]{2}:[0-9]{2})?$"
_TIME_PY = re.compile(_TIME.replace("$", r"\Z"))
_HEX = re.compile(r"(?:[0-9A-Fa-f]{2})*\Z")
_DIGITS = re.compile(r"[0-9]*\Z")

OUTPUT = "received_us bigint, payload_hex string, observation_id bigint, ground_station string, reason string"
_ARROW = [("received_us", pa.int64()), ("payload_hex", pa.string()), ("observation_id", pa.int64()), ("ground_station", pa.string()), ("reason", pa.string())]


def _unquoted(field: pa.Array) -> pa.Array:
    quoted = pc.starts_with(field, '"')
    if not pc.any(quoted, min_count=0).as_py():
        return field
    inner = pc.replace_substring(pc.utf8_slice_codeunits(field, 1, -1), '""', '"')
    return pc.if_else(quoted, inner, field)


def isolated(kernel: Callable[[pa.Array], pa.Array], values: pa.Array, at: int = 0) -> Iterator[int]:
    """Places of the values that make a kernel fail, found by halving what fails."""
    try:
        kernel(values)
    except pa.ArrowInvalid:
        n = len(values)
        if n == 1:
            yield at
        else:
            yield from isolated(kernel, values.slice(0, n // 2), at)
            yield from isolated(kernel, values.slice(n // 2), at + n // 2)


class _Rows:
    """The lines of a block that are still valid: their places, and the columns made of them so far."""

    def __init__(self, lines: pa.Array) -> None:
        self.places = np.arange(len(lines))
        self.columns: dict[str, pa.Array] = {"line": lines}

    def keep(self, fine: pa.Array) -> None:
        """Drops the lines of which ``fine`` is not true."""
        mask = pc.fill_null(fine, False)
        if not pc.all(mask, min_count=0).as_py():
            self.places = self.places[np.asarray(mask.to_numpy(zero_copy_only=False), bool)]
            self.columns = {k: v.filter(mask) for k, v in self.columns.items()}

    def cast(self, name: str, kernel: Callable[[pa.Array], pa.Array]) -> None:
        """Replaces a column by what a kernel makes of it that only fails as a whole; drops the lines it fails at."""
        try:
            self.columns[name] = kernel(self.columns[name])
        except pa.ArrowInvalid:
            fine = np.ones(len(self.places), bool)
            fine[list(isolated(kernel, self.columns[name]))] = False
            self.keep(pa.array(fine))
            self.columns[name] = kernel(self.columns[name])

    def split(self, name: str, pattern: str, parts: dict[str, str]) -> None:
        """Adds a column for each group of the pattern; drops the lines that do not match."""
        found = pc.extract_regex(self.columns.pop(name), pattern)
        self.columns["_"] = found
        self.keep(found.is_valid())
        found = self.columns.pop("_")
        self.columns |= {to: pc.struct_field(found, [group]) for group, to in parts.items()}


def parse_block(lines: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """(places of the valid lines, their output columns)."""
    rows = _Rows(lines)
    c = rows.columns
    c["line"] = pc.replace_substring_regex(lines, r"\r$", "")
    rows.keep(lines.is_valid())
    rows.split("line", _ROW, {"a": "when", "b": "payload", "c": "observation", "d": "station"})
    rows.columns = {k: _unquoted(v) for k, v in rows.columns.items()}
    rows.split("when", _TIME, {"day": "day", "h": "h", "m": "m", "s": "s", "f": "f", "z": "z"})
    rows.keep(pc.greater_equal(rows.columns["day"], "0001"))
    rows.cast("day", lambda x: pc.cast(pc.cast(x, pa.date32()), pa.int32()))
    c = rows.columns
    c["z"] = pc.replace_with_mask(c["z"], pc.or_(pc.equal(c["z"], "Z"), pc.equal(c["z"], "")), "+00:00")
    c["zh"], c["zm"] = (pc.utf8_slice_codeunits(c["z"], a, a + 2) for a in (1, 4))
    c |= {k: pc.cast(c[k], pa.int64()) for k in ("h", "m", "s", "zh", "zm")}
    within = [pc.less(c[k], limit) for k, limit in (("h", 24), ("m", 60), ("s", 60), ("zh", 24), ("zm", 60))]
    rows.keep(reduce(pc.and_, within))
    rows.columns["payload"] = pc.replace_substring_regex(rows.columns["payload"], "[ \t]", "")
    rows.keep(pc.match_substring_regex(rows.columns["payload"], rf"^(?:[0-9A-Fa-f]{{2}}){{{LEAST_BYTES},}}$"))
    rows.keep(pc.match_substring_regex(rows.columns["observation"], "^[0-9]*$"))
    rows.cast("observation", lambda x: pc.cast(pc.replace_with_mask(x, pc.equal(x, ""), pa.scalar(None, pa.string())), pa.int64()))
    c = rows.columns
    away = pc.multiply(pc.if_else(pc.starts_with(c["z"], "-"), -1, 1), pc.add(pc.multiply(c["zh"], 3600), pc.multiply(c["zm"], 60)))
    clock = pc.add(pc.add(pc.multiply(c["h"], 3600), pc.multiply(c["m"], 60)), pc.subtract(c["s"], away))
    seconds = pc.add(pc.multiply(pc.cast(c["day"], pa.int64()), 86400), clock)
    micros = pc.cast(pc.utf8_rpad(pc.utf8_slice_codeunits(c["f"], 0, 6), 6, "0"), pa.int64())
    return rows.places, [pc.add(pc.multiply(seconds, 1_000_000), micros), pc.ascii_lower(c["payload"]), c["observation"], c["station"], pa.nulls(len(rows.places), pa.string())]


def split_line(line: str) -> list[str] | None:
    """The fields, or None for a quoting fault."""
    fields, at = [], 0
    while True:
        if line.startswith('"', at):
            part, at = [], at + 1
            while True:
                end = line.find('"', at)
                if end < 0:
                    return None
                part.append(line[at:end])
                if not line.startswith('"', end + 1):
                    break
                part.append('"')
                at = end + 2
            at = end + 1
            if at < len(line) and line[at] != "|":
                return None
            fields.append("".join(part))
        else:
            end = line.find("|", at)
            end = len(line) if end < 0 else end
            if '"' in line[at:end]:
                return None
            fields.append(line[at:end])
            at = end
        if at >= len(line):
            return fields
        at += 1
        if at == len(line):
            return [*fields, ""]


def diagnose(line: str | None) -> str | None:
    """The first reason that applies to one line; None for a valid one."""
    if line is None:
        return "columns"
    line = line.removeprefix(BOM).removesuffix("\r")
    fields = split_line(line)
    if fields is None:
        return "quoting"
    if len(fields) != 4:
        return "columns"
    when, payload, observation, _ = fields
    m = _TIME_PY.match(when)
    if not m:
        return "timestamp"
    try:
        date.fromisoformat(m["day"])
    except ValueError:
        return "timestamp"
    zone = m["z"] or "Z"
    if int(m["h"]) > 23 or int(m["m"]) > 59 or int(m["s"]) > 59 or (zone != "Z" and (int(zone[1:3]) > 23 or int(zone[4:]) > 59)):
        return "timestamp"
    digits = payload.replace(" ", "").replace("\t", "")
    if not _HEX.match(digits) or len(digits) < 2 * LEAST_BYTES:
        return "payload"
    if not _DIGITS.match(observation) or (observation and int(observation[-40:]) > 2**63 - 1) or len(observation.lstrip("0")) > 19:
        return "observation"
    return None


def parse_batch(lines: pa.Array, block_rows: int) -> list[pa.Array]:
    """The output columns of a batch, in its order."""
    places: list[np.ndarray] = []
    parts: list[list[pa.Array]] = []
    for a in range(0, len(lines), block_rows):
        block = lines.slice(a, block_rows)
        good, columns = parse_block(block)
        places.append(good + a)
        parts.append(columns)
        bad = np.setdiff1d(np.arange(len(block)), good, assume_unique=True)
        if len(bad):
            reasons = [diagnose(block[int(i)].as_py()) for i in bad]
            if None in reasons:
                raise AssertionError(f"the kernels refuse a valid line: {block[int(bad[reasons.index(None)])].as_py()!r}")
            places.append(bad + a)
            parts.append([pa.nulls(len(bad), t) for _, t in _ARROW[:-1]] + [pa.array(reasons, pa.string())])
    if not parts:
        return [pa.array([], t) for _, t in _ARROW]
    order = pa.array(np.argsort(np.concatenate(places), kind="stable"))
    return [pa.concat_arrays([p[k].cast(t) for p in parts]).take(order) for k, (_, t) in enumerate(_ARROW)]


def parse_lines(df: DataFrame, key: str = "line_id", line: str = "raw_line", block_rows: int = 4096) -> DataFrame:
    """(key, received_us, payload_hex, observation_id, ground_station, reason), one row a line.

    ``reason`` is null for the loaded rows and tells the fault of the others, whose parsed columns are null.
    ``received_us`` is epoch microseconds; a time without zone counts as UTC. No shuffle.
    """
    source = df.select(F.col(key).alias("k"), F.col(line).cast("string").alias("line"))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = parse_batch(b.column(1), block_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["k", *[n for n, _ in _ARROW]])

    return source.mapInArrow(run, f"k {kind}, {OUTPUT}").withColumnRenamed("k", key)


def loaded(parsed: DataFrame) -> DataFrame:
    """The valid rows."""
    return parsed.filter("reason IS NULL").drop("reason")


def faults(parsed: DataFrame) -> DataFrame:
    """Key and reason of the others."""
    return parsed.filter("reason IS NOT NULL").select(parsed.columns[0], "reason")


__all__ = ["diagnose", "faults", "isolated", "loaded", "parse_block", "parse_lines", "split_line"]
