"""Observations from a paged JSON service, or from its saved pages."""

from __future__ import annotations

import json
import logging
import re
from collections import Counter
from collections.abc import Callable, Iterator
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id string, ground_station string, start string, end string, station_lat double, station_lng double, observer string, status string"
_NEXT = re.compile(r'<([^>]+)>\s*;\s*rel="?next"?')
_FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def next_link(header: str | None) -> str | None:
    """The address of the next page in a Link header."""
    found = [m for part in (header or "").split(",") if (m := _NEXT.search(part))]
    return found[0][1] if found else None


def _fetch(url: str, token: str | None, timeout: float) -> tuple[list[dict], str | None]:
    request = Request(url, headers={"Authorization": f"Token {token}"} if token else {})  # noqa: S310
    with urlopen(request, timeout=timeout) as r:  # noqa: S310
        return json.loads(r.read()), next_link(r.headers.get("Link"))


def pages(url: str, filters: dict[str, str], token: str | None = None, timeout: float = 15.0, fetch: Callable | None = None) -> Iterator[list[dict]]:
    """Pages in order, empty ones skipped. The cursor makes this sequential."""
    at = f"{url}?{urlencode({k: v for k, v in filters.items() if v})}"
    while at:
        rows, at = (fetch or _fetch)(at, token, timeout)
        if rows:
            yield rows


def row(observation: dict) -> tuple:
    text = lambda v: None if v is None else str(v)
    number = lambda v: None if v is None else float(v)
    return tuple(number(observation.get(f)) if f in ("station_lat", "station_lng") else text(observation.get(f)) for f in _FIELDS)


def unexpected(page: list[dict], status: str | None) -> dict[str, int]:
    """How often a page holds each status that was not asked for; such observations are kept all the same."""
    return dict(Counter(str(o.get("status")) for o in page if status and o.get("status") != status))


class ObservationReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = {**options}

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:  # noqa: ARG002
        o = self.options
        filters = {"satellite__norad_cat_id": o.get("norad_id"), "status": o.get("status", "future"), "start": o.get("start"), "start__lt": o.get("start_lt"), "end__gt": o.get("end_gt"), "format": "json", "page_size": o.get("page_size", "100")}
        for page in pages(o["url"], filters, o.get("token"), float(o.get("timeout", "15"))):
            if other := unexpected(page, filters["status"]):
                logging.getLogger(__name__).warning("observations of status %s among those asked for as %s", other, filters["status"])
            yield from map(row, page)


class ObservationSource(DataSource):
    """``spark.read.format("observations").option("url", ...)``: filters run at the service."""

    @classmethod
    def name(cls) -> str:
        return "observations"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001, ARG002
        return ObservationReader(self.options)


def read_service(spark: SparkSession, url: str, **options: str) -> DataFrame:
    spark.dataSource.register(ObservationSource)
    return spark.read.format("observations").option("url", url).options(**options).load()


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages: files that each hold a JSON array."""
    return spark.read.schema(SCHEMA).option("multiLine", "true").json(path)
