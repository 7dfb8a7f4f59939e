"""Readers of received packets: pipe-delimited text, the archive's SQLite table, whole files, command lists."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from groundlake.functions.commands import lines_of
from groundlake.functions.csp import HEADER_BITS
from groundlake.operators import rejects
from groundlake.operators.decode import observation_id

CSV_SCHEMA = "received_timestamp string, hex_payload string, observation_id bigint, ground_station string"
_COLUMNS = ("ts_received", "payload", "rs_errs", "session_dir", *[n for n, _ in HEADER_BITS])
ARCHIVE_SCHEMA = "ts_received string, payload binary, rs_errs int, session_dir string, " + ", ".join(f"{n} int" for n, _ in HEADER_BITS)


def read_csv(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Pipe-delimited packets without a header, a quote in a quoted field doubled. ``strict`` fails on a bad line; else bad values are null.

    To keep bad lines with the reason, read them as text and use ``read_lines``.
    """
    return spark.read.schema(CSV_SCHEMA).option("sep", "|").option("escape", '"').option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, parsed columns, reason) of text exports; see operators.rejects."""
    raw = spark.read.text(path).select(F.struct(F.input_file_name().alias("file"), F.col("value").alias("text")).alias("k"), F.col("value").alias("line"))
    return rejects.parse_lines(raw, "k", "line").select("k.*", "*").drop("k")


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class ArchiveReader(DataSourceReader):
    """Reads ranges of row ids in parallel; the filter on rs_errs runs in SQLite."""

    def __init__(self, options: dict) -> None:
        self.path, self.table = options["path"], options.get("table", "packet")
        self.least = options.get("least_errors", "0")
        self.parts = int(options.get("partitions", "8"))
        if not self.table.isidentifier():
            raise ValueError("table: a plain name")

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()  # noqa: S608
        if low is None:
            return [_Range(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        where = "" if self.least == "" else f" AND rs_errs >= {int(self.least)}"
        sql = f"SELECT CAST(ts_received AS TEXT), {', '.join(_COLUMNS[1:])} FROM {self.table} WHERE rowid BETWEEN ? AND ?{where}"  # noqa: S608
        connection = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            for row in connection.execute(sql, (partition.low, partition.high)):
                yield (row[0], None if row[1] is None else bytearray(row[1]), *row[2:])
        finally:
            connection.close()


class ArchiveSource(DataSource):
    """``spark.read.format("packet_archive").option("path", file).load()``; the file must be reachable by executors."""

    @classmethod
    def name(cls) -> str:
        return "packet_archive"

    def schema(self) -> str:
        return ARCHIVE_SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001, ARG002
        return ArchiveReader(self.options)


def read_archive(spark: SparkSession, path: str, table: str = "packet", partitions: int = 8) -> DataFrame:
    """Packets with ``rs_errs >= 0`` of an SQLite archive, with the observation id of their session folder."""
    spark.dataSource.register(ArchiveSource)
    rows = spark.read.format("packet_archive").option("path", path).option("table", table).option("partitions", str(partitions)).load()
    return rows.withColumn("observation_id", observation_id(F.col("session_dir"))).withColumn("ground_station", F.lit(None).cast("string"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def command_list(df: DataFrame, column: str) -> DataFrame:
    """One row for each command line that is not blank: (position, command)."""
    return df.select(F.posexplode(lines_of(F.col(column))).alias("position", "command"))
