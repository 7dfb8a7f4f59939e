"""Agenda sheets: small files that are parsed on the driver and become all-string tables."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone
from itertools import zip_longest
from pathlib import Path
from xml.etree import ElementTree
from zipfile import ZipFile

from pyspark.sql import DataFrame, SparkSession

#: how cells of each type read; others as Python writes them
_WRITTEN = {
    type(None): lambda v: "",
    float: lambda v: f"{v:.0f}" if v == v // 1 else repr(v),
    time: lambda v: f"{v:%H:%M:%S}",
    date: date.isoformat,
    datetime: datetime.isoformat,
}
#: fixed values: numbers of the built-in formats of workbooks that show dates, times, and both
_DATE_FORMATS = {14: "d", 15: "d", 16: "d", 17: "d", 18: "t", 19: "t", 20: "t", 21: "t", 22: "dt", 45: "t", 46: "t", 47: "t"}


@dataclass(frozen=True)
class Sheet:
    mission_date: str
    mission_start_ms: int
    columns: dict[str, list[str]]

    @property
    def n_rows(self) -> int:
        return len(next(iter(self.columns.values()), []))

    def table(self, spark: SparkSession) -> DataFrame:
        """The body as strings, with ``row_no`` from 0."""
        schema = "row_no int, " + ", ".join(f"`{c}` string" for c in self.columns)
        return spark.createDataFrame(list(zip(range(self.n_rows), *self.columns.values(), strict=True)), schema)


def written(value: object) -> str:
    """A cell's text."""
    return _WRITTEN.get(type(value), str)(value)


def _workbook(path: str) -> list[list[object]]:
    """Values of the first sheet of an XLSX file, which is a ZIP of XML; dates and times by their cells' formats."""
    tag = lambda e: e.tag.rpartition("}")[2]
    with ZipFile(path) as z:
        tree = lambda name: ElementTree.fromstring(z.read(name)) if name in z.namelist() else ElementTree.Element("none")  # noqa: E731, S314
        shared = ["".join(t.text or "" for t in e.iter() if tag(t) == "t") for e in tree("xl/sharedStrings.xml") if tag(e) == "si"]
        styles = tree("xl/styles.xml")
        own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in styles.iter() if tag(e) == "numFmt"}
        kinds = [_format_kind(int(x.get("numFmtId", 0)), own) for e in styles if tag(e) == "cellXfs" for x in e]
        sheet = tree(min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet")))
    grid: dict[int, dict[int, object]] = {}
    for cell in (e for e in sheet.iter() if tag(e) == "c"):
        letters, number = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
        column = 0
        for c in letters:
            column = column * 26 + ord(c) - 64
        text = "".join(e.text or "" for e in cell.iter() if tag(e) in ("v", "t"))
        kind, style = cell.get("t", "n"), kinds[int(cell.get("s", 0))] if kinds else ""
        value: object = text
        if kind == "s":
            value = shared[int(text)]
        elif kind == "b":
            value = text == "1"
        elif kind == "n":
            value = _dated(float(text), style) if text else None
        grid.setdefault(int(number), {})[column] = value
    return [[grid.get(r, {}).get(c) for c in range(1, max(grid.get(r, {0: None})) + 1)] for r in range(1, max(grid, default=0) + 1)]


def _format_kind(number: int, own: dict[int, str]) -> str:
    """"d" for dates, "t" for times, "dt" for both, else empty."""
    code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(number, "")).lower()
    return _DATE_FORMATS.get(number) or "".join(k for k, letters in (("d", "yd"), ("t", "hs")) if any(x in code for x in letters))


def _dated(value: float, kind: str) -> object:
    if not kind:
        return value
    at = datetime(1899, 12, 30) + timedelta(seconds=round(value * 86400))
    return at.time() if value < 1 and "t" in kind else at


def cells(path: str) -> list[list[str]]:
    """Cells of a CSV file (a byte-order mark is dropped) or of an XLSX file's first sheet."""
    if Path(path).suffix.lower() in (".xlsx", ".xlsm"):
        return [[written(v) for v in row] for row in _workbook(path)]
    with Path(path).open(encoding="utf-8-sig", newline="") as f:
        return list(csv.reader(f))


def day_of(text: str | None) -> str | None:
    """The first date in ISO form in a text."""
    return next(iter(re.findall(r"\d{4}-\d{2}-\d{2}", text or "")), None)


def parse(rows: list[list[str]]) -> Sheet:
    """The date and start labels above a table, whose right neighbours hold their values, and the table below ``Mode``.

    Cells are indexed by their text first. Of equal labels the first counts, of equal column names the last.
    """
    width = max(map(len, rows), default=0)
    index: dict[str, list[tuple[int, int]]] = {}
    for r, row in enumerate(rows):
        for c, text in enumerate(row):
            index.setdefault(" ".join(str(text).split()), []).append((r, c))
    if "Mode" not in index:
        raise ValueError("no cell reads Mode")
    top, left = index["Mode"][0]
    above = sorted((place, text.lower()) for text, places in index.items() for place in places if place < (top, left))
    beside = {label: rows[r][c + 1] for (r, c), label in reversed(above) if c + 1 < len(rows[r])}
    start = beside.get("start utc", "")
    day = day_of(beside.get("date")) or day_of(start)
    if day is None:
        raise ValueError("no mission date")
    begins = datetime.fromisoformat((start or day).strip())
    begins = begins if begins.tzinfo else begins.replace(tzinfo=timezone.utc)  # noqa: UP017
    body = [row for row in rows[top + 1 :] if "".join(row[left:]).strip()]
    names = [" ".join(text.split()) for text in rows[top][left:]]
    by_column = list(zip_longest(*(row[left:width] for row in body), fillvalue=""))
    by_column += [("",) * len(body)] * (len(names) - len(by_column))
    return Sheet(day, int(begins.timestamp() * 1000), {name: list(values) for name, values in zip(names, by_column, strict=False)})


def read_sheet(path: str) -> Sheet:
    return parse(cells(path))
