"""A gazetteer and country names out of the public time-zone tables that systems carry (``zone.tab``, ``iso3166.tab``)."""

from __future__ import annotations

import re
from importlib.util import find_spec
from pathlib import Path
from zoneinfo import TZPATH

from pyspark.sql import DataFrame, SparkSession

_POINT = re.compile(r"([+-])(\d{2})(\d{2})(\d{2})?([+-])(\d{3})(\d{2})(\d{2})?")


def table_path(name: str) -> str:
    """Where one of the tables lies: in the system's zone folders, else in the package tzdata."""
    folders = [*TZPATH, *([Path(s.origin).parent / "zoneinfo"] if (s := find_spec("tzdata")) and s.origin else [])]
    for folder in folders:
        if (at := Path(folder) / name).is_file():
            return str(at)
    raise FileNotFoundError(f"no {name} in {folders}; give a gazetteer of your own")


def _lines(path: str) -> list[list[str]]:
    return [x.split("\t") for x in Path(path).read_text(encoding="utf-8").splitlines() if x and not x.startswith("#")]


def degrees(sign: str, whole: str, minutes: str, seconds: str | None) -> float:
    return (-1 if sign == "-" else 1) * (int(whole) + int(minutes) / 60 + int(seconds or 0) / 3600)


def gazetteer(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(place_lat, place_lng, code): a few hundred places with their ISO 3166 country."""
    rows = []
    for code, point, *_ in _lines(path or table_path("zone.tab")):
        m = _POINT.fullmatch(point)
        rows.append((degrees(*m.groups()[:4]), degrees(*m.groups()[4:]), code))
    return spark.createDataFrame(rows, "place_lat double, place_lng double, code string")


def country_names(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(code, country)."""
    return spark.createDataFrame([(r[0], r[1]) for r in _lines(path or table_path("iso3166.tab"))], "code string, country string")
