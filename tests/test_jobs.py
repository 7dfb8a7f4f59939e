"""Jobs from files to files, their texts, and the readers they use."""

import json
import sqlite3
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from groundlake import jobs
from groundlake.operators import agenda, coverage
from groundlake.sources import places, sheets

SHEET = """﻿,,,,,,,,,,
Start UTC,2026-07-05T07:03:00,,,,,,,,,
Notes,,,,,,,,,,
Mode,tssent (UTC),tsexec Start (UTC),tsexec End (UTC),Interval,Telecommand,resp_fname,Repeat,Random,TCMD Notes,
Single,past,0,0,,"CTS1+set(a,1)!",,5,10,,
Single,7:14:00,7:14:00,,,CTS1+format()!,data/{DATE}.run,3,3,,
,,,,,,,,,,
Single,7:5,7:9:1,,,CTS1+late()!,,1,,note,
Interval,8:15:00,8:15:00,8:20:00,30 sec,"CTS1+index(0,0)!",,,,,
"""


def test_sheet_to_agenda(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text(SHEET, encoding="utf-8")
    out = tmp_path / "agenda.txt"
    n = jobs.sheet_to_agenda(spark, str(tmp_path / "sheet.csv"), str(out), seed=3, with_times=True)
    lines = out.read_text().splitlines()
    commands = [x for x in lines if x and not x.startswith("#")]
    assert n == len(commands) == 5 + 10 + 3 + 3 + 1 + 11
    assert lines[0].startswith("# +--") and "| set(a,1) " in lines[3] and lines[3].startswith("# |") and "" in lines
    assert commands.count("CTS1+set(a,1)@tssent=0@tsexec=0!") == 15
    assert commands.count("CTS1+format()@tssent=1783235640000@tsexec=1783235640000@resp_fname=data/2026-07-05.run!") == 6
    assert "CTS1+late()@tssent=1783235100000@tsexec=1783235341000!" in commands  # one-digit minutes
    fixed = [x for x in commands if "index" in x]  # keep their order among the scattered ones
    assert [int(x.split("@tssent=")[1].split("@")[0]) for x in fixed] == [1783239300000 + 30_000 * k for k in range(11)]
    shown = (tmp_path / "agenda_readable.txt").read_text().splitlines()
    assert "tssent: 2026-07-05T07:14:00.000Z | tsexec: 2026-07-05T07:14:00.000Z | " in "\n".join(shown)
    again = tmp_path / "b.txt"
    jobs.sheet_to_agenda(spark, str(tmp_path / "sheet.csv"), str(again), seed=3, summary_table=False)
    assert again.read_text().splitlines() == commands


def workbook(path, rows):
    """A workbook whose cells are (reference, type, value, style)."""
    cell = lambda r, t, v, s: f'<c r="{r}" s="{s}"' + (f' t="{t}"' if t else "") + (f"><is><t>{v}</t></is></c>" if t == "inlineStr" else f"><v>{v}</v></c>")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Mode</t></si><si><r><t>Start </t></r><r><t>UTC</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="21"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f"<row>{''.join(cell(*c) for c in row)}</row>" for row in rows) + "</sheetData></worksheet>")


def test_workbooks_read_as_text(tmp_path):
    path = str(tmp_path / "s.xlsx")
    at = (datetime(2026, 7, 5, 7, 3) - datetime(1899, 12, 30)) / timedelta(days=1)
    workbook(path, [[("A1", "s", 1, 0), ("B1", "", at, 1)], [("B3", "s", 0, 0), ("C3", "inlineStr", "tssent (UTC)", 0), ("D3", "inlineStr", "Repeat", 0)], [("B4", "inlineStr", "Single", 0), ("C4", "", 7.25 / 24, 2), ("D4", "", 3, 0)]])
    assert sheets.cells(path) == [["Start UTC", "2026-07-05T07:03:00"], [], ["", "Mode", "tssent (UTC)", "Repeat"], ["", "Single", "07:15:00", "3"]]
    sheet = sheets.read_sheet(path)
    assert sheet.columns == {"Mode": ["Single"], "tssent (UTC)": ["07:15:00"], "Repeat": ["3"]} and sheet.mission_date == "2026-07-05"


def test_sheets_without_what_they_need():
    with pytest.raises(ValueError, match="Mode"):
        sheets.parse([["Date", "2026-07-05"]])
    with pytest.raises(ValueError, match="date"):
        sheets.parse([["Date", "soon"], ["Mode", "x"]])
    sheet = sheets.parse([["date", "on 2026-07-05"], ["DATE", "2026-07-06"], [], ["Date", "2026-07-07", "Mode", "a", "a", "b"], ["x", "", "Single", "1", "2"], ["", "", " ", ""], ["", "", "Interval"]])
    assert sheet.mission_date == "2026-07-05" and sheet.columns == {"Mode": ["Single", "Interval"], "a": ["2", ""], "b": ["", ""]}
    assert sheets.parse([["Date", "2026-07-05"], ["Mode", "x"]]).n_rows == 0


def test_decode_packets(spark, tmp_path):
    (tmp_path / "p.csv").write_text("2026-01-05T00:00:02Z|aabbccdd0341|7|Yard\n2026-01-05T00:00:01Z|zz||\n2026-01-05T00:00:03Z|aabbccdd0341|8|\n")
    out = jobs.decode_packets(spark, input_csv=str(tmp_path / "p.csv"))
    assert out.path == str(tmp_path / "p-decoded.csv") and out.last_beacon is None and out.types == [("LOG_MESSAGE", 2), (None, 1)]
    got = spark.read.option("header", "true").csv(out.path).collect()
    assert [r.hex_payload for r in got] == ["aabbccdd0341", "zz", "aabbccdd0341"]  # in the order of the file
    assert list(got[0].asDict())[:4] == ["received_timestamp", "observation_id", "packet_type", "general_message"] and list(got[0].asDict())[-4:] == ["log_message", "tcmd_response_text", "bulk_data_hex", "hex_payload"]
    assert (got[0].log_message, got[0].general_message, got[0].ground_station, got[1].packet_type) == ("A", "A", "Yard", None)
    from test_reference_operators import beacon

    with sqlite3.connect(tmp_path / "a.db") as c:
        c.execute("CREATE TABLE packet (ts_received TEXT, payload BLOB, rs_errs INT, session_dir TEXT, csp_prio INT, csp_src INT, csp_dst INT, csp_dport INT, csp_sport INT, csp_flags INT)")
        c.executemany("INSERT INTO packet VALUES (?,?,?,?,1,2,3,4,5,6)", [("2026-01-01", b"\x03x", 0, "/x/3/"), ("2026-01-03", beacon(), 0, "/x/4"), ("2026-01-02", beacon(), 1, None), ("2026-01-04", b"\x03y", -1, None)])
    out = jobs.decode_packets(spark, input_sqlite=str(tmp_path / "a.db"), output_csv=str(tmp_path / "o.csv"))
    got = spark.read.option("header", "true").csv(out.path).collect()
    assert [r.received_timestamp[:10] for r in got] == ["2026-01-03", "2026-01-02", "2026-01-01"] and got[0].hex_payload.startswith("44310506")
    assert out.last_beacon["received_timestamp"] == "2026-01-03" and not any(k.startswith(("tcmd_", "log_", "bulk_")) for k in out.last_beacon) and "satellite_name" in out.text()
    for wrong in ({}, {"input_csv": "a", "input_sqlite": "b"}):
        with pytest.raises(ValueError, match="exactly one"):
            jobs.decode_packets(spark, **wrong)


OBSERVATIONS = [
    {"id": 1, "ground_station": 7, "start": "2026-01-05T23:50:00Z", "end": "2026-01-06T00:10:05Z", "station_lat": 52.5, "station_lng": 13.4, "observer": "o"},
    {"id": 2, "ground_station": 8, "start": "2026-01-06T01:00:00+01:00", "end": "2026-01-06T00:05:00Z", "station_lat": 48.9, "station_lng": 2.3, "observer": "p"},
    {"id": 123456789, "ground_station": 7, "start": "2026-01-06T02:00:00Z", "end": "2026-01-06T02:01:00Z", "station_lat": 52.5, "station_lng": 13.4, "observer": "o"},
    {"id": 4, "ground_station": 9, "start": "2026-01-06T03:00:00", "end": "2026-01-06T03:10:00Z", "station_lat": None, "station_lng": None, "observer": None},
]


def test_coverage_report(spark, tmp_path):
    (tmp_path / "page.json").write_text(json.dumps(OBSERVATIONS))
    run = lambda **more: jobs.coverage_report(spark, str(tmp_path / "page.json"), start="2026-01-05T00:00:00Z", hours=48, **more)
    out = run(detail=True, obs_ids=True, tsv=str(tmp_path / "x" / "c.tsv"))
    assert out.rejects == 1 and out.exported
    assert out.text.splitlines() == [
        "Combined Coverage Windows (UTC)", "─" * 80,
        "┌──────────┬─────────────────────┬─────────────────────┬──────────┬───────────┐",
        "│ Stations ┆     Start (UTC)     ┆      End (UTC)      ┆ Duration ┆  Obs IDs  │",
        "╞══════════╪═════════════════════╪═════════════════════╪══════════╪═══════════╡",
        "│     2    ┆ 2026-01-05T23:50:00 ┆ 2026-01-06T00:10:05 ┆  20m 5s  ┆    1, 2   │",
        "│     1    ┆ 2026-01-06T02:00:00 ┆       02:01:00      ┆   1m 0s  ┆ 123456789 │",
        "└──────────┴─────────────────────┴─────────────────────┴──────────┴───────────┘",
        "  2 window(s)  |  Total coverage: 0h 21m 5s  |  2 simultaneous station(s)", "",
        "═" * 80, "Detailed Coverage Breakdown", "─" * 80,
        "Window   1  |  up to 2 stn (peak)  |  2026-01-05T23:50:00 → 2026-01-06T00:10:05  |  20m 5s",
        "          Obs 1         GS 7      23:50:00Z → 00:10:05Z  (20m 5s)", "          Obs 2         GS 8      00:00:00Z → 00:05:00Z  (5m 0s)",
        "Window   2  |  up to 1 stn (peak)  |  2026-01-06T02:00:00 → 02:01:00  |  1m 0s", "          Obs 123456789  GS 7      02:00:00Z → 02:01:00Z  (1m 0s)", "═" * 80,
    ]
    assert (tmp_path / "x" / "c.tsv").read_text() == "total_stations\twindow_start_utc\twindow_end_utc\tduration\n2\t2026-01-05T23:50:00\t2026-01-06T00:10:05\t20m 5s\n1\t2026-01-06T02:00:00\t02:01:00\t1m 0s\n"
    none = run(min_stations=5, tsv=str(tmp_path / "none.tsv"))
    assert none.text == coverage.NO_WINDOWS and not none.exported and not (tmp_path / "none.tsv").exists()
    assert jobs.coverage_report(spark, str(tmp_path / "page.json"), start="2030-01-05T00:00:00Z", norad_id="1").text == coverage.NO_WINDOWS  # only the one that cannot be read is left
    with pytest.raises(ValueError, match="after the start"):
        run(end="2026-01-05T00:00:00Z")
    with pytest.raises(ValueError, match="zone"):
        jobs.span("2026-01-05T00:00:00", None, 1)
    assert jobs.main(["coverage-report", str(tmp_path / "page.json"), "--start", "2026-01-05T00:00:00Z", "--end", "2026-01-04T00:00:00Z"]) == 1 and jobs.main(["nothing"]) == 2


def test_passes_to_agenda(spark, tmp_path):
    (tmp_path / "page.json").write_text(json.dumps(OBSERVATIONS[:3] + [OBSERVATIONS[2]]))
    plan = agenda.PassPlan(uplink_start_ms=1767650400000, loop_commands=["a()", "CTS1+b()!"], priority_commands=["p()@tsexec=5"], block_ms=300_000, command_ms=1000, priority_every=3, satellite="99", mission="M", next_hours=12.0)
    out = tmp_path / "agenda.txt"
    n = jobs.passes_to_agenda(spark, str(tmp_path / "page.json"), str(out), plan, generated="now")
    lines = out.read_text().splitlines()
    assert lines[:6] == ["# M Command Agenda", "# Satellite NORAD ID: 99", "# Uplink window: 2026-01-05 22:00:00 UTC -> 2026-01-05 22:15:00 UTC (15.0 min)", "# Observation fetch window end: 12.0 hrs after uplink", "# Generated at: now", "# Valid observations: 4"]
    at = lines.index("# PRIORITY COMMANDS")
    assert lines[at - 1] == "" and lines[at + 1] == "CTS1+p()@tssent=1767650400000@tsexec=5!  # tssent=2026-01-05T22:00:00Z tsexec=1970-01-01T00:00:00Z" and lines[at + 2 : at + 5] == ["", "# Timeline start: 2026-01-05 23:50:00 UTC", ""]
    body = lines[at + 5 :]
    assert body[0] == "# AOS | 2026-01-05 23:50:00 UTC | Observation 1 | GS 7 @ 52.5, 13.4 (in Germany) | Observer: o | 1 station(s) in sight"
    assert body[1].startswith("CTS1+a()@tssent=1767650401000@tsexec=1767657000000!") and body[2].startswith("CTS1+b()@tssent=1767650402000@tsexec=1767657001000!")
    assert body[4:6] == ["# PRIORITY [3]", lines[at + 1]]
    assert [x[:5] + x.split(" | ")[-1][0] for x in body if x.startswith(("# AOS", "# LOS"))] == ["# AOS1", "# AOS2", "# LOS1", "# LOS0", "# AOS1", "# AOS1", "# LOS0", "# LOS0"]  # one id twice is in sight once
    assert n == sum(bool(x) and not x.startswith("#") for x in lines) == 1 + 3 + 2 * 6
    with pytest.raises(ValueError, match="no valid observations"):
        jobs.passes_to_agenda(spark, str(tmp_path / "page.json"), str(out), agenda.PassPlan(uplink_start_ms=1867650400000, loop_commands=["a()"]))
    with pytest.raises(ValueError, match="holds"):
        jobs.passes_to_agenda(spark, str(tmp_path / "page.json"), str(out), agenda.PassPlan(uplink_start_ms=1767650400000, loop_commands=["a()!@x"]))


def test_file_to_commands(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(bytes(range(200)))
    out = tmp_path / "c.txt"
    n = jobs.file_to_commands(spark, str(tmp_path / "f.bin"), "dir/f", str(out), hash_count=2, tssent_start="1970-01-01T00:00:01+00:00", tsexec_start=3600, mode="bulk_uplink_hex")
    lines = out.read_text().splitlines()
    assert n == len(lines) == 4 + 3 + 2 + 10
    assert lines[0] == "CTS1+comms_bulk_uplink_close_file()@tssent=1000@tsexec=3600000!" and lines[1] == "CTS1+config_set_int_var(TCMD_require_unique_tssent,1)@tssent=2000!" and lines[2] == "CTS1+comms_bulk_uplink_open_file(dir/f,truncate)@tssent=3000@tsexec=3630000!"
    assert lines[-9:] == ["# Generated with arguments:", "#   input_file.name=f.bin", "#   satellite_file=dir/f", "#   chunk_size=96", "#   tssent_start_val=1970-01-01T00:00:01+00:00", "#   tssent_interval_ms=1000", "#   tsexec_start_val=3600", "#   tsexec_interval_ms=30000", "#   mode=bulk_uplink_hex"]
    with pytest.raises(ValueError, match="zone"):
        agenda.instant_argument("2027-01-01T00:00:00")


def test_iso_texts_with_a_zone(spark):
    texts = {"2026-01-05T10:00:00Z": 10.0, "20260105T100000Z": 10.0, "2026-01-05 10:00+01:00": 9.0, "2026-01-05T10+00": 10.0, "2026-01-05T10:00:00.5-0130": 11.5 + 0.5 / 3600, "2026-01-05T10:00:00,123456789Z": 10 + 0.123456 / 3600, "2026-01-05T10:00:00": None, "2026-13-05T10:00:00Z": None, "2026-01-05T25:00:00Z": None, "soon": None, "": None, "2026-01-05": None}
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r.t: r.us for r in df.select("t", F.unix_micros(coverage.iso_instant(F.col("t"))).alias("us")).collect()}
    assert got == {t: None if h is None else 1767571200000000 + round(h * 3_600_000_000) for t, h in texts.items()} | {None: None}


def test_local_times_over_a_change_of_clocks(spark):
    df = spark.sql("SELECT explode(array(timestamp'2026-03-08T08:59:59Z', timestamp'2026-03-08T09:00:00Z', timestamp'2026-01-05T00:00:00.9Z')) AS t")
    assert [r[0] for r in df.select(coverage.local_text(F.col("t"), "America/Edmonton")).collect()] == ["2026-03-08T01:59:59-07:00", "2026-03-08T03:00:00-06:00", "2026-01-04T17:00:00-07:00"]


def test_countries(spark):
    points = spark.createDataFrame([(k, lat, lng) for k, (lat, lng) in enumerate([(52.5, 13.4), (52.5, 13.4), (-36.8, 174.7), (None, 1.0), (90.0, 0.0)])], "k int, lat double, lng double")
    got = {r.k: r.country for r in coverage.with_country(points, places.gazetteer(spark), places.country_names(spark), "lat", "lng").collect()}
    assert (got[0], got[1], got[2], got[3]) == ("Germany", "Germany", "New Zealand", None) and got[4]
    with pytest.raises(ValueError, match="more than 10"):
        coverage.nearest_place(points, places.gazetteer(spark), "lat", "lng", most_places=10)
