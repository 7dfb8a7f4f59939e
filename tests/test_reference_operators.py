"""Golden bytes, readers and agendas on small cases; the queries are held against DuckDB by tests/compare.py."""

import json
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from groundlake.functions import binary, commands
from groundlake.operators import agenda, decode
from groundlake.sources import observations, packets, sheets


def beacon(kind=1, message=b"Hello from orbit"):
    fixed = struct.pack("<B4sBBIIQBBHHIBBIHHBhhiIiiiiiBBBBBBBB", kind, b"CTS1", 1, 0, 5000, 0, 1700000000000, 1, 1, 2, 0, 7, 1, 9, 60, 0, 4000, 80, 2500, -2600, 3, 0x80000001, 500, 450, 490, -440, 2000, 4, 2, 1, 0, 0, 0, 1, 2)
    assert len(fixed) == 84
    return fixed + message.ljust(42, b"\0") + (b"END\0" if kind == 1 else b" X2\0")


@pytest.mark.parametrize("engine", ["arrow", "native"])
def test_golden_packets(spark, engine):
    tail = struct.pack("<Bhb12hHhh6s8B3hH3h3h", 25, 7400, -99, *[5000, 100, 90] * 4, 0x8000, -50, 300, bytes.fromhex("010203040506"), *range(10, 80, 10), 90, 100, -100, 200, 150, 10, -10, 20, 500, -500, 1000)
    rows = [(1, beacon()), (2, beacon(0x20) + tail), (3, b"\x03one\ntwo\nthree"), (4, struct.pack("<BQBHBB", 4, 12345678, 0, 50, 0, 0) + b"OK\0x"), (5, b"\x10" + struct.pack("<I", 7) + bytes.fromhex("aa4412ff")), (6, b"\x02ab"), (7, b"\x77"), (8, beacon()[:100]), (9, None), (10, b"")]
    df = spark.createDataFrame([(k, None if b is None else bytearray(b), "aabbccdd", True) for k, b in rows], "id int, payload binary, csp_header_hex string, csp_crc_valid boolean")
    got = {r["id"]: r.asDict() for r in decode.decode(df, engine).collect()}
    assert [got[k]["packet_type"] for k in range(1, 11)] == ["BEACON_BASIC", "BEACON_EXTENDED", "LOG_MESSAGE", "TCMD_RESPONSE", "BULK_FILE_DOWNLINK", "BEACON_PERIPHERAL", "UNKNOWN", "BEACON_BASIC", None, None]
    b = got[1]
    assert (b["satellite_name"], b["uptime_sec"], b["utc_time"], b["eps_mode"], b["eps_reset_cause"]) == ("CTS1", 5.0, "2023-11-14T22:13:20+00:00Z", "NOMINAL", "UNKNOWN(9)")
    assert (b["eps_battery_voltage_V"], b["eps_battery_temperature_1_C"], b["eps_enabled_channels_bitfield"], b["eps_total_avg_pcu_power_output_W"], b["friendly_message"]) == (4.0, -26.0, "0x80000001", -4.4, "Hello from orbit")
    x = got[2]
    assert (x["end_version_number"], x["mpi_last_temperature_C"], x["eps_battery_pack_status_bitfield"], x["adcs_magnetic_field_y_uT"], x["adcs_raw_css_9"]) == (" X2", -99, "0x8000", -1.0, 90)
    assert x["adcs_attitude_estimation_mode"].startswith("1 - MEMS") and json.loads(x["adcs_enabled"]) == [n for k, n in decode.L.STATE_BITS["adcs_enabled"].items() if (0x060504030201 >> k) & 1]
    assert got[3]["log_message"] == got[3]["general_message"] == "one\ntwo" and got[4]["tcmd_response_text"] == "OK" and got[4]["tcmd_ts_sent"] == 12345678
    assert got[5]["general_message"] == "<BINARY DATA: 4 bytes, maybe binary GNSS data>" and got[5]["bulk_data_len"] == 4 and got[6]["raw_payload_hex"] == "026162"
    assert got[8]["satellite_name"] is None and got[8]["csp_header_hex"] == "aabbccdd" and got[9]["csp_header_hex"] is None


def test_hex_packets_and_text_rules(spark):
    df = spark.createDataFrame([("AABBCCDD 0341",), ("aabbccdd",), ("abc",), ("zz",), (None,)], "hex_payload string")
    assert [r.payload and bytes(r.payload) for r in decode.from_hex(df).collect()] == [b"\x03A", None, None, None, None]
    t = spark.createDataFrame([(bytearray(b"a\xffb\0c"),)], "b binary")
    r = t.select(binary.until_nul(binary.utf8(F.col("b"))).alias("u"), binary.ascii_text(F.col("b")).alias("a"), binary.number("b", 1, "b").alias("n")).head()
    assert (r.u, r.a, r.n) == ("a�b", "a�b\0c", -1)


def test_commands(spark):
    df = spark.createDataFrame([("CTS1+set(1)@tsexec=50@x=1!",)], "c string")
    core, at = commands.priority_parts(F.col("c"))
    r = df.select(core.alias("core"), at.alias("at"), commands.pass_command(F.lit("hi()"), F.lit(1000), F.lit(0)).alias("line")).head()
    assert (r.core, r["at"]) == ("set(1)@x=1", 50)
    assert r.line == "CTS1+hi()@tssent=1000@tsexec=0!  # tssent=1970-01-01T00:00:01Z tsexec=immediate"
    assert agenda.forbidden(spark.createDataFrame([("a)!@b",), ("a",)], "line string")).count() == 1


def test_sheet(spark, tmp_path):
    text = "﻿x,Start UTC,2026-07-05T07:03:00\n\nMode,tssent (UTC),tsexec Start (UTC),tsexec End (UTC),Interval,Telecommand,resp_fname,Repeat,Random\nSingle,past,7:14:00,,,CTS1+a({DATE})!,,2,1\n,,\nInterval,,7:00,7:30,10 min,CTS1+b()!,f_{DATE},,\n"
    (tmp_path / "s.csv").write_text(text, encoding="utf-8")
    sheet = sheets.read_sheet(str(tmp_path / "s.csv"))
    assert sheet.mission_date == "2026-07-05" and sheet.n_rows == 2
    ordered, loose = agenda.sheet_agenda(sheet.table(spark), sheet.mission_date, sheet.mission_start_ms)
    lines = [r.line for r in ordered.orderBy("tssent_ms", "row_no", "copy").collect()]
    assert lines[:2] == ["CTS1+a(2026-07-05)@tssent=0@tsexec=1783235640000!"] * 2 and len(lines) == 2
    assert loose.count() == 1  # the interval begins before the mission and ends after it, so it starts a day late
    out = agenda.scattered(ordered, loose, ["tssent_ms", "row_no", "copy"], ["row_no", "copy"], 3, F.lit(0))
    assert sorted(r.slot for r in out.collect()) == [1, 2, 3]


def test_archive_file_and_text_reader(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE packet (ts_received TEXT, payload BLOB, rs_errs INT, session_dir TEXT, csp_prio INT, csp_src INT, csp_dst INT, csp_dport INT, csp_sport INT, csp_flags INT)")
        c.executemany("INSERT INTO packet VALUES (?,?,?,?,1,2,3,4,5,6)", [(f"2026-01-0{k}", b"\x03x", k - 2, f"/x/{k}/") for k in range(1, 6)])
    assert sorted(r.observation_id for r in packets.read_archive(spark, path, partitions=2).collect()) == [2, 3, 4, 5]
    (tmp_path / "p.csv").write_text("2026-01-05T00:00:00Z|aabbccdd03|7|Yard\n")
    assert packets.read_csv(spark, str(tmp_path / "p.csv")).head().observation_id == 7
    assert packets.read_lines(spark, str(tmp_path / "p.csv")).head().payload_hex == "aabbccdd03"


def test_pages():
    served = {"u?a=1": ([{"id": 1}], "u2"), "u2": ([], "u3"), "u3": ([{"id": 2, "station_lat": 1}], None)}
    found = list(observations.pages("u", {"a": "1", "b": ""}, fetch=lambda at, token, timeout: served[at]))
    assert [p[0]["id"] for p in found] == [1, 2] and observations.row(found[1][0])[4] == 1.0
    assert observations.unexpected([{"status": "future"}, {"status": "bad"}, {}], "future") == {"bad": 1, "None": 1}
    assert observations.next_link('<http://x?c=2>; rel="next", <http://x>; rel="prev"') == "http://x?c=2"


def test_agendas_combine_stations(spark, tmp_path):
    from datetime import datetime, timedelta

    from groundlake.plans import agenda_queries

    t = lambda m: datetime(2026, 1, 6) + timedelta(minutes=m)
    rows = [(1, "s1", "o", t(0), t(2), 1.0, 2.0), (2, "s2", "o", t(1), t(3), 1.0, 2.0), (3, "s3", "p", t(1), t(2), None, None), (4, None, "o", t(1), t(9), 1.0, 2.0)]
    spark.createDataFrame(rows, "observation_id bigint, ground_station_id string, observer string, start_utc timestamp, end_utc timestamp, station_lat double, station_lng double").write.parquet(str(tmp_path / "obs_interval.parquet"))
    spark.createDataFrame([(1, "x" * 100)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    query = lambda name: agenda_queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted((r.observer, r.tick) for r in query("pass_ticks")) == [("o", k) for k in range(9)] + [("p", k) for k in range(3)]
    assert [r.line.rsplit(" | ", 1)[1][0] for r in sorted(query("pass_remarks")) if r.observer == "o"] == ["1", "2", "1", "0"]
    assert len(query("pass_commands")) == 36
    lines = [r.line for r in sorted(query("pass_agenda"), key=lambda r: (r.observer, r.line_no)) if r.observer == "p"]
    assert lines[0] == "# DEMO Command Agenda" and lines[-1].startswith("# LOS") and sum(x.startswith("CTS1") for x in lines) == 2 + 9
    for name in ("file_uplink_hex", "file_uplink_base64"):
        assert sum(r.phase == 5 for r in query(name)) == 30


def test_decoded_by_receipt_returns_the_rows(spark):
    from groundlake.plans import decoding

    folder = "/root/testdata/sf0.001"
    packets = spark.read.parquet(f"{folder}/packet.parquet").filter("rs_errs >= 0")
    df = decoding.decoded_by_receipt(spark, folder)
    assert [c for c in df.columns if c != "place"] == decoding._decoded(spark, folder).columns
    got = df.select("packet_id", "received_timestamp").collect()
    assert sorted(r.packet_id for r in got) == sorted(r.packet_id for r in packets.select("packet_id").collect())
    times = [r.received_timestamp for r in got]
    nulls = sum(t is None for t in times)
    assert all(t is None for t in times[:nulls]) and times[nulls:] == sorted(times[nulls:], reverse=True)
