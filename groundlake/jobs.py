"""Jobs from files to files, and their command line: ``python -m groundlake JOB ...``.

The results are DataFrames up to the last step; a job that promises one file writes it through ``sinks.single_file``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundlake.functions.commands import FORBIDDEN, readable
from groundlake.functions.ordered import running_sums
from groundlake.operators import agenda, coverage, decode
from groundlake.sinks import files
from groundlake.sources import observations, packets, places, sheets

#: column order of decoded tables
_FIRST, _LAST = ["received_timestamp", "observation_id"], ["log_message", "tcmd_response_text", "bulk_data_hex", "hex_payload"]


@dataclass(frozen=True)
class Decoded:
    path: str
    last_beacon: dict | None
    types: list[tuple[str | None, int]]

    def text(self) -> str:
        lines = []
        if self.last_beacon:
            lines += ["-- Last BEACON_BASIC packet " + "-" * 37, *[f"  {k:<44} {v}" for k, v in self.last_beacon.items()], ""]
        return "\n".join([*lines, "-- Packet type summary " + "-" * 42, *[f"  {k!s:<44} {n}" for k, n in self.types]])


def stemmed(path: str, ending: str, suffix: str | None = None) -> str:
    """A path whose stem has ``ending`` behind it, with another suffix if one is given."""
    at = PurePosixPath(path)
    return str(at.with_name(at.stem + ending + (at.suffix if suffix is None else suffix)))


def decoded_table(spark: SparkSession, input_csv: str | None = None, input_sqlite: str | None = None) -> DataFrame:
    """Decoded packets of exactly one input: of a text file in its order, of an archive the latest first."""
    if (input_csv is None) == (input_sqlite is None):
        raise ValueError("give exactly one of input_csv and input_sqlite")
    if input_csv is not None:
        rows = decode.from_hex(packets.read_csv(spark, input_csv).withColumn("_order", F.monotonically_increasing_id()))
        out = decode.decode(rows.orderBy("_order"))
    else:
        raw = packets.read_archive(spark, input_sqlite)
        rows = decode.from_archive(raw).withColumn("hex_payload", F.concat("csp_header_hex", F.lower(F.hex("payload"))))
        out = decode.decode(decode.by_receipt(rows))
    own = [c for c in decode.decoded_columns() if c not in (*decode.START, *_LAST)]
    extra = [c for c in out.columns if c not in (*_FIRST, *decode.START, *own, *_LAST, "_order")]
    special = [c for c in own if c.startswith(("tcmd_", "bulk_"))]
    return out.select(*_FIRST, *decode.START, *special, *extra, *[c for c in own if c not in special], *_LAST)


def decode_packets(spark: SparkSession, input_csv: str | None = None, input_sqlite: str | None = None, output_csv: str | None = None) -> Decoded:
    """Writes the decoded table beside its input, or to ``output_csv``; returns the last basic beacon and counts by type."""
    table = decoded_table(spark, input_csv, input_sqlite)
    path = output_csv or stemmed(input_csv or input_sqlite, "-decoded", ".csv")
    files.single_file(table, path, "csv", header="true")
    last = decode.last_beacon(table).head()
    counts = table.groupBy("packet_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "packet_type").collect()
    return Decoded(path, last.asDict() if last else None, [(r[0], r[1]) for r in counts])


def span(start: str | None, end: str | None, hours: float, now: datetime | None = None) -> tuple[datetime, datetime]:
    """The span to search: from now on and for ``hours`` if nothing else is said; texts must carry a zone."""
    at = lambda text: datetime.fromtimestamp(agenda.instant_argument(text) / 1000, timezone.utc)  # noqa: E731, UP017
    begin = at(start) if start else now or datetime.now(timezone.utc)  # noqa: UP017
    until = at(end) if end else begin + timedelta(hours=hours)
    if until <= begin:
        raise ValueError("the end must lie after the start")
    return begin, until


def fetched(spark: SparkSession, source: str, norad_id: str, begin: datetime, until: datetime) -> DataFrame:
    """Observations of a service (an address) or of its saved pages (a path), which begin within the span."""
    if source.startswith(("http://", "https://")):
        iso = lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ")
        return observations.read_service(spark, source, norad_id=norad_id, start=iso(begin), start_lt=iso(until))
    start = coverage.iso_instant(F.col("start"))
    inside = start.between(F.lit(begin.isoformat()).cast("timestamp"), F.lit(until.isoformat()).cast("timestamp"))
    return observations.read_json(spark, source).filter(F.coalesce(inside, F.lit(True)))  # unreadable ones are rejected later


@dataclass(frozen=True)
class Report:
    text: str
    rejects: int
    exported: bool


def coverage_report(spark: SparkSession, source: str, norad_id: str = "", start: str | None = None, end: str | None = None, hours: float = 24.0, *, sort: str = "time", min_stations: int = 1, detail: bool = False, obs_ids: bool = False, tsv: str | None = None) -> Report:
    """The text report of coverage windows, and a tab-separated export if ``tsv`` names a file."""
    raw = fetched(spark, source, norad_id, *span(start, end, hours))
    if raw.isEmpty():
        return Report("No observations found in the specified window.", 0, False)
    good, bad = coverage.split_rejects(coverage.observations(raw))
    numbered = running_sums(good, [], F.floor(F.unix_micros("start") / F.lit(86_400_000_000)), ["start", "id", "ground_station"], {"ordinal": F.lit(1)})
    members = files.kept(coverage.assign_windows(files.kept(numbered, "numbered"), []), "members")
    found = files.kept(coverage.windows(members, [], obs_ids), "windows")
    text = [r.line for r in coverage.summary_lines(found, min_stations, sort, obs_ids).orderBy("seq").collect()]
    if detail:
        wanted = coverage.filtered(found, min_stations, sort)
        text += ["", *[r.line for r in coverage.detail(wanted, members, [], sort).orderBy("row_no", "member_no").collect()]]
    return Report("\n".join(text), bad.count(), bool(tsv) and files.coverage_tsv(found, tsv, min_stations, sort))


def sheet_to_agenda(spark: SparkSession, input_file: str, output_file: str = "agenda_output.txt", seed: int | None = None, *, with_times: bool = False, summary_table: bool = True) -> int:
    """Writes the agenda of a sheet, and beside it one with readable times; returns the number of commands."""
    sheet = sheets.read_sheet(input_file)
    table = sheet.table(spark)
    ordered, loose = agenda.sheet_agenda(table, sheet.mission_date, sheet.mission_start_ms)
    keys = ["tssent_ms", "row_no", "copy"]
    seed = int(datetime.now(timezone.utc).timestamp()) if seed is None else seed  # noqa: UP017
    lines = files.kept(agenda.scattered(ordered, loose, keys, ["row_no", "copy"], seed, F.floor(F.col("tssent_ms") / F.lit(3_600_000))), "agenda")
    head = [*files.summary_comment(table), "", ""] if summary_table else []
    for path, shown in ((output_file, F.col("line")), *([(stemmed(output_file, "_readable"), readable(F.col("line")))] if with_times else [])):
        files.text_file(lines.select("slot", shown.alias("line")), path, ["slot"], head)
    return lines.count()


def file_to_commands(spark: SparkSession, input_file: str, satellite_file: str, output_file: str, *, chunk_size: int = 96, tssent_start: int | str | None = None, tssent_interval_ms: int = 1000, tsexec_start: int | str | None = None, tsexec_interval_ms: int = 30_000, hash_count: int = 30, mode: str = "bulk_uplink_b64") -> int:
    """Writes the commands that send a file; returns the number of lines. A start that is 0 gives no tsexec tags."""
    source = packets.read_files(spark, input_file).select(F.lit(0).alias("k"), "content", F.lit(satellite_file).alias("target"), F.regexp_extract("path", "[^/]+$", 0).alias("name"))
    rows = agenda.file_uplink(
        source, ["k"], "content", "target", mode=mode, size=chunk_size, hash_count=hash_count, tssent_start_ms=agenda.instant_argument(tssent_start), tssent_step_ms=tssent_interval_ms,
        tsexec_start_ms=agenda.instant_argument(tsexec_start), tsexec_step_ms=tsexec_interval_ms, name="name", given={"tssent_start_val": tssent_start, "tsexec_start_val": tsexec_start},
    )
    return files.text_file(rows, output_file, ["phase", "step"])


def passes_to_agenda(spark: SparkSession, source: str, output_file: str, plan: agenda.PassPlan, *, generated: str | None = None, gazetteer: DataFrame | None = None, names: DataFrame | None = None) -> int:
    """Writes the command agenda of the observations after the uplink; returns the number of commands."""
    raw = coverage.with_country(observations.read_json(spark, source), gazetteer or places.gazetteer(spark), names or places.country_names(spark), "station_lat", "station_lng")
    info = coverage.info_text(F.col("country"))
    ms = lambda c: F.unix_millis(coverage.iso_instant(F.col(c)))
    passes = files.kept(raw.select(F.lit(0).alias("k"), "id", ms("start").alias("start_ms"), ms("end").alias("end_ms"), info.alias("info")), "passes")
    if agenda.upcoming(passes, ["k"], plan).isEmpty():
        raise ValueError("no valid observations: all are before the end of the uplink window")
    lines = files.kept(agenda.pass_agenda(passes, ["k"], plan, generated or datetime.now(timezone.utc).isoformat()), "agenda")  # noqa: UP017
    if (wrong := agenda.forbidden(lines).head()) is not None:
        raise ValueError(f"a command line holds {FORBIDDEN!r}: {wrong.line}")
    files.text_file(lines, output_file, ["phase", "a", "b", "c"])
    return lines.filter("line <> '' AND NOT startswith(line, '#')").count()


JOBS: dict[str, Callable] = {f.__name__.replace("_", "-"): f for f in (decode_packets, coverage_report, sheet_to_agenda, file_to_commands)}


def main(arguments: list[str]) -> int:
    """0 if the job ran, 1 if its arguments or input are wrong, 2 for an unknown job. Options are ``--name value``, flags ``--name``."""
    if not arguments or arguments[0] not in JOBS:
        print(f"jobs: {', '.join(JOBS)}")
        return 2
    from groundlake.session import local_session

    given: list[str] = []
    options: dict[str, object] = {}
    rest = arguments[1:]
    while rest:
        word = rest.pop(0)
        if not word.startswith("--"):
            given.append(word)
            continue
        value: object = rest.pop(0) if rest and not rest[0].startswith("--") else True
        options[word[2:].replace("-", "_")] = int(value) if isinstance(value, str) and value.lstrip("-").isdigit() else value
    try:
        out = JOBS[arguments[0]](local_session(), *given, **options)
    except (ValueError, TypeError, FileNotFoundError) as e:
        print(f"{arguments[0]}: {e}")
        return 1
    print(out.text() if isinstance(out, Decoded) else out.text if isinstance(out, Report) else out)
    return 0
