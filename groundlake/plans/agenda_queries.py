"""Agenda queries: passes of obs_interval by observer, sheets and files derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundlake.functions import commands
from groundlake.functions.ordered import running_sums
from groundlake.operators import agenda, coverage
from groundlake.plans import coverage_queries
from groundlake.plans.tables import table
from groundlake.sources import places

PLAN = agenda.PassPlan(
    uplink_start_ms=1_767_571_200_000, loop_commands=["CTS1+echo_back_args(a)!", "hello_world()", "CTS1+get_time()"],
    priority_commands=["CTS1+set_mode(2)@tsexec=1767600000000!", "reboot()"], satellite="12345", mission="DEMO",
)
#: One timeline combines the stations of an observer.
KEYS = ["observer"]
GENERATED = "2026-01-05T00:00:00+00:00"


def _passes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "obs_interval").filter("ground_station_id IS NOT NULL AND start_utc IS NOT NULL AND end_utc IS NOT NULL").dropDuplicates()
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return rows.select("observer", F.col("observation_id").alias("id"), ms("start_utc").alias("start_ms"), ms("end_utc").alias("end_ms"), F.col("ground_station_id").alias("ground_station"), "station_lat", "station_lng")


def _ticks(spark: SparkSession, folder: str) -> DataFrame:
    return agenda.active_ticks(agenda.sights(agenda.upcoming(_passes(spark, folder), KEYS, PLAN), KEYS), KEYS, PLAN.block_ms)


def _commands(spark: SparkSession, folder: str) -> DataFrame:
    return agenda.loop_commands(_ticks(spark, folder), KEYS, PLAN)


def pass_ticks(spark: SparkSession, folder: str) -> DataFrame:
    return _ticks(spark, folder)


def pass_commands(spark: SparkSession, folder: str) -> DataFrame:
    return _commands(spark, folder).select("observer", "n", "line")


def pass_priorities(spark: SparkSession, folder: str) -> DataFrame:
    return agenda.injections(_commands(spark, folder), KEYS, PLAN)


def pass_remarks(spark: SparkSession, folder: str) -> DataFrame:
    return agenda.pass_events(agenda.upcoming(_passes(spark, folder), KEYS, PLAN), KEYS).select("observer", F.col("ordinal").cast("bigint").alias("ordinal"), "line")


def pass_agenda(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of each observer's agenda with its place, checked for forbidden text."""
    located = coverage.with_country(_passes(spark, folder), places.gazetteer(spark), places.country_names(spark), "station_lat", "station_lng")
    passes = located.withColumn("info", coverage.info_text(F.col("country")))
    return agenda.lines_in_order(agenda.checked(agenda.pass_agenda(passes, KEYS, PLAN, GENERATED)), KEYS)


def forbidden_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Commands that carry a tag behind their end, among some that do not."""
    rows = table(spark, folder, "agenda").select("agenda_id", F.concat(F.lit("CTS1+run("), F.col("agenda_id").cast("string"), F.when(F.col("agenda_id") % 5 == 0, ")!@x=1!").otherwise(")!")).alias("line"))
    return agenda.forbidden(rows)


def readable_commands(spark: SparkSession, folder: str) -> DataFrame:
    return _commands(spark, folder).select("observer", "n", commands.readable(F.col("line")).alias("line"))


def sheet_agenda(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the agenda of a sheet whose rows are derived from agenda, in order."""
    i = F.col("agenda_id")
    single = i % 3 != 0
    clock = F.format_string("%d:%02d:%02d", i % 24, i % 30, i % 60)
    sheet = table(spark, folder, "agenda").filter("agenda_id IS NOT NULL").select(
        i.cast("int").alias("row_no"), F.when(single, " Single").otherwise("interval").alias("Mode"), F.when(single & (i % 11 == 0), "past").otherwise(F.format_string("%d:%d", i % 24, i % 60)).alias("tssent (UTC)"),
        F.when(single & (i % 13 == 0), "0").otherwise(clock).alias("tsexec Start (UTC)"), F.format_string("%d:%02d:%02d", i % 24, i % 30 + i % 7, i % 60).alias("tsexec End (UTC)"),
        F.when(i % 2 == 0, "30 sec").otherwise("1.5 Minutes").alias("Interval"), F.concat(F.lit("CTS1+cmd_{DATE}("), i.cast("string"), F.lit(")!")).alias("Telecommand"), F.when(i % 2 == 0, "").otherwise("log_{DATE}.txt").alias("resp_fname"),
        F.when(i % 4 == 0, "").otherwise((i % 4).cast("string")).alias("Repeat"), F.lit("").alias("Random"),
    )
    ordered, _ = agenda.sheet_agenda(sheet, "2026-01-05", 1_767_571_200_000)
    out = running_sums(ordered, [], F.floor(F.col("tssent_ms") / F.lit(600_000)), ["tssent_ms", "row_no", "copy"], {"line_no": F.lit(1)})
    return out.select(F.col("line_no").cast("bigint").alias("line_no"), "line")


def command_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of every text that are not blank, as lists of commands are read."""
    docs = table(spark, folder, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(commands.lines_of(F.col("text"))).alias("position", "command"))


def interval_steps(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "obs_interval").select("observation_id", F.unix_micros(F.col("start_utc").cast("timestamp")).alias("a"), F.unix_micros(F.col("end_utc").cast("timestamp")).alias("z"), F.lit(90_000_000).cast("bigint").alias("step"))
    return agenda.stepped(rows.filter("a IS NOT NULL AND z IS NOT NULL"), "a", "z", "step").select("observation_id", "at")


def repeated_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "beacon").select("beacon_id", (F.col("beacon_id") % 4).alias("n"))
    return agenda.repeated(rows, "n").select("beacon_id", "copy")


def sheet_values(spark: SparkSession, folder: str) -> DataFrame:
    """Times of day, spans and numbers as sheets write them, derived from agenda."""
    i = F.col("agenda_id")
    rows = table(spark, folder, "agenda").select(
        "agenda_id", F.when(i % 7 == 0, "past").when(i % 7 == 1, "").when(i % 7 == 2, F.format_string("%d:%d", i % 24, i % 60)).otherwise(F.format_string("%d:%02d:%02d", i % 24, i % 60, i % 59)).alias("clock"),
        F.format_string("%s %s", F.col("next_hours").cast("string"), F.when(i % 2 == 0, "sec").otherwise("Minutes")).alias("span"), F.when(i % 5 == 0, "nan").otherwise(F.col("uplink_dur_min").cast("string")).alias("number"),
    )
    start = F.lit(1_767_578_400_000).cast("bigint")  # 2026-01-05T02:00:00Z
    return rows.select("agenda_id", agenda.clock_time(F.col("clock"), F.lit("2026-01-05"), start).alias("ms"), agenda.span_us(F.col("span")).alias("span_us"), agenda.whole_number(F.col("number")).alias("number"))


def scattered_commands(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "agenda").select(F.col("agenda_id").alias("k"), F.concat(F.lit("c"), F.col("agenda_id").cast("string")).alias("line"))
    return agenda.scattered(rows.filter("k % 10 <> 0"), rows.filter("k % 10 = 0"), ["k"], ["k"], 7, F.floor(F.col("k") / F.lit(8192)))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return docs.withColumn("target", F.concat(F.lit("store_"), F.col("doc_id").cast("string")))


def file_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return agenda.chunks(_files(spark, folder), ["doc_id"], "content", 96).select("doc_id", "chunk", "offset", F.lower(F.hex("data")).alias("data_hex"))


def file_uplink_hex(spark: SparkSession, folder: str) -> DataFrame:
    return agenda.file_uplink(_files(spark, folder), ["doc_id"], "content", "target", mode="bulk_uplink_hex", tssent_start_ms=1_767_571_200_000, tsexec_start_ms=1_767_574_800_000).filter("phase < 6")


def file_uplink_base64(spark: SparkSession, folder: str) -> DataFrame:
    return agenda.file_uplink(_files(spark, folder), ["doc_id"], "content", "target", tssent_start_ms=1_767_571_200_000).filter("phase < 6")


def file_writes(spark: SparkSession, folder: str) -> DataFrame:
    """The whole command file of each text, written without bulk commands and untimed, with checksum and arguments."""
    files = _files(spark, folder).withColumn("name", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    return agenda.file_uplink(files, ["doc_id"], "content", "target", mode="write_file_hex", hash_count=2, name="name")


QUERIES = {f.__name__: f for f in (pass_ticks, pass_commands, pass_priorities, pass_remarks, pass_agenda, forbidden_lines, readable_commands, sheet_agenda, command_lines, interval_steps, repeated_rows, sheet_values, scattered_commands, file_chunks, file_uplink_hex, file_uplink_base64, file_writes)}

_START, _END = PLAN.uplink_start_ms, PLAN.uplink_end_ms
_stamp = lambda ms: f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%SZ')"
_line = lambda text, sent, executed: f"'CTS1+' || {text} || '@tssent=' || ({sent}) || '@tsexec=' || ({executed}) || '!  # tssent=' || {_stamp(sent)} || ' tsexec=' || CASE WHEN {executed} = 0 THEN 'immediate' ELSE {_stamp(executed)} END"
_PASSES = f"""passes AS (SELECT DISTINCT observer, observation_id AS id, epoch_ms(start_utc) AS s, epoch_ms(end_utc) AS e, ground_station_id, station_lat, station_lng, obs_status FROM obs_interval
  WHERE ground_station_id IS NOT NULL AND end_utc >= start_utc AND epoch_ms(start_utc) > {_END}),
ends AS (SELECT *, s AS t, 0 AS k, 'AOS' AS kind FROM passes UNION ALL SELECT *, e, 1, 'LOS' FROM passes),
turned AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY observer, id ORDER BY t, s, k), 'LOS') <> kind AS fresh FROM ends),
changes AS (SELECT *, CASE WHEN NOT fresh THEN 0 WHEN kind = 'AOS' THEN 1 ELSE -1 END AS d FROM turned),
seen AS (SELECT *, lead(t) OVER (PARTITION BY observer, id ORDER BY t, s, k) AS until FROM changes WHERE d <> 0),
spans AS (SELECT observer, min(s) AS first, max(e) AS last, count(*) AS n_valid FROM passes GROUP BY ALL),
grid AS (SELECT observer, k AS tick, first + k * {PLAN.block_ms} AS t_ms FROM spans, unnest(range(0, (last - first) // {PLAN.block_ms} + 1)) u(k)),
ticks AS (SELECT * FROM grid g WHERE EXISTS (SELECT 1 FROM seen p WHERE p.kind = 'AOS' AND p.observer = g.observer AND p.t <= g.t_ms AND g.t_ms < p.until)),
loops AS (SELECT *, row_number() OVER (PARTITION BY observer ORDER BY tick, i) - 1 AS n FROM ticks, (VALUES (0, 'echo_back_args(a)'), (1, 'hello_world()'), (2, 'get_time()')) c(i, cmd)),
commands AS (SELECT observer, n, t_ms, {_line('cmd', f'{_START} + (n + 2) * 1000', f't_ms + i * {PLAN.command_ms}')} AS line FROM loops),
priorities AS (SELECT observer, n, t_ms, i AS position, {_line('cmd', f'{_START} + i * 1000', 'x')} AS line FROM commands, (VALUES (0, 'set_mode(2)', 1767600000000), (1, 'reboot()', 0)) c(i, cmd, x) WHERE n > 0 AND n % {PLAN.priority_every} = 0
  UNION ALL SELECT observer, n, t_ms, -1, '# PRIORITY [' || n || ']' FROM commands WHERE n > 0 AND n % {PLAN.priority_every} = 0)"""


def _remarks(info: str) -> str:
    return f"""remarks AS (SELECT observer, t, row_number() OVER w AS ordinal, '# ' || kind || ' | ' || strftime(make_timestamp(t * 1000), '%Y-%m-%d %H:%M:%S UTC') || ' | ' || {info} || ' | ' || CAST(sum(d) OVER (PARTITION BY observer ORDER BY t, s, id, k, abs(d) DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) || ' station(s) in sight' AS line
      FROM changes WINDOW w AS (PARTITION BY observer ORDER BY t, s, id, k, abs(d) DESC))"""


_FILES = """files AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n, encode(text) AS content FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT doc_id, n, CAST(k AS INT) AS chunk, CAST(k * 96 AS INT) AS "offset", lower(substr(h, CAST(k * 192 + 1 AS BIGINT), 192)) AS data_hex FROM files, unnest(range(0, (n + 95) // 96)) u(k))"""


def _uplink(data: str, tsexec: bool) -> str:
    run = "'@tsexec=' || (1767574800000 + (i - CASE WHEN i > 1 THEN 1 ELSE 0 END) * 30000)" if tsexec else "''"
    return f"""WITH {_FILES}, counted AS (SELECT doc_id, 'store_' || doc_id AS target, (n + 95) // 96 AS m FROM files),
      rows AS (SELECT doc_id, 0 AS phase, 0 AS step, 'CTS1+comms_bulk_uplink_close_file()' AS c, 0 AS i FROM counted
      UNION ALL SELECT doc_id, 1, 0, 'CTS1+config_set_int_var(TCMD_require_unique_tssent,1)', 1 FROM counted
      UNION ALL SELECT doc_id, 2, 0, 'CTS1+comms_bulk_uplink_open_file(' || target || ',truncate)', 2 FROM counted
      UNION ALL SELECT doc_id, 3, chunk, {data}, chunk + 3 FROM pieces
      UNION ALL SELECT doc_id, 4, 0, 'CTS1+comms_bulk_uplink_close_file()', m + 3 FROM counted
      UNION ALL SELECT doc_id, 5, k, 'CTS1+fs_read_file_sha256_hash_json(' || target || ',0,0)', m + 4 + k FROM counted, unnest(range(0, 30)) u(k))
      SELECT doc_id, phase, step, c || '@tssent=' || (1767571200000 + i * 1000) || CASE WHEN phase = 1 THEN '' ELSE {run} END || '!' AS line FROM rows"""


_BLANKS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_HEAD = ["# DEMO Command Agenda", "# Satellite NORAD ID: 12345", "# Uplink window: 2026-01-05 00:00:00 UTC -> 2026-01-05 00:15:00 UTC (15.0 min)", "# Observation fetch window end: 24.0 hrs after uplink", "# Generated at: 2026-01-05T00:00:00+00:00"]
_MORE = ["# Time between loop command blocks: 20.0 s", "# Time between commands in a loop block: 2.0 s", "# Priority command injection interval: every 50 loop commands", "# Loop commands (3):", "#   CTS1+echo_back_args(a)!", "#   hello_world()", "#   CTS1+get_time()", "# Priority commands (2):", "#   CTS1+set_mode(2)@tsexec=1767600000000!", "#   reboot()", ""]
_listed = lambda lines, first: ", ".join(f"({first + i}, '{x}')" for i, x in enumerate(lines))
ORACLE = {
    "pass_ticks": f"WITH {_PASSES} SELECT * FROM ticks",
    "pass_commands": f"WITH {_PASSES} SELECT observer, n, line FROM commands",
    "pass_priorities": f"WITH {_PASSES} SELECT observer, n, position, line FROM priorities",
    "pass_remarks": f"WITH {_PASSES}, {_remarks("'Observation ' || id")} SELECT observer, ordinal, line FROM remarks",
    "readable_commands": f"WITH {_PASSES} SELECT observer, n, 'tssent: ' || strftime(make_timestamp(CAST(regexp_extract(line, '@tssent=(\\d+)', 1) AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') || ' | tsexec: ' || strftime(make_timestamp(CAST(regexp_extract(line, '@tsexec=(\\d+)', 1) AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') || ' | ' || line AS line FROM commands",
    "forbidden_lines": "SELECT agenda_id, 'CTS1+run(' || agenda_id || ')!@x=1!' AS line FROM agenda WHERE agenda_id % 5 = 0",
    "sheet_agenda": """WITH v AS (SELECT agenda_id AS i, ((agenda_id % 24) * 60 + agenda_id % 30) * 60 + agenda_id % 60 AS c, ((agenda_id % 24) * 60 + agenda_id % 60) * 60 AS a FROM agenda),
      singles AS (SELECT i, k, CASE WHEN i % 11 = 0 THEN 0 ELSE 1767571200000 + a * 1000 END AS sent, CASE WHEN i % 13 = 0 THEN 0 ELSE 1767571200000 + c * 1000 END AS run FROM v, unnest(range(0, i % 4)) u(k) WHERE i % 3 <> 0),
      runs AS (SELECT i, k, 1767571200000 + (c + k) * 1000 AS sent, 1767571200000 + (c + k) * 1000 AS run FROM v, unnest(range(0, (i % 7) * 60 + 1, CASE WHEN i % 2 = 0 THEN 30 ELSE 90 END)) u(k) WHERE i % 3 = 0),
      every AS (SELECT * FROM singles UNION ALL SELECT * FROM runs)
      SELECT row_number() OVER (ORDER BY sent, i, k) AS line_no, 'CTS1+cmd_2026-01-05(' || i || ')@tssent=' || sent || '@tsexec=' || run || CASE WHEN i % 2 = 0 THEN '' ELSE '@resp_fname=log_2026-01-05.txt' END || '!' AS line FROM every""",
    "command_lines": rf"""WITH lines AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^[{_BLANKS}]+|[{_BLANKS}]+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, CAST(k - 1 AS INT) AS position, l[k] AS command FROM lines, unnest(range(1, len(l) + 1)) u(k)""",
    "interval_steps": "SELECT observation_id, \"at\" FROM (SELECT observation_id, unnest(range(epoch_us(start_utc), epoch_us(end_utc) + 1, 90000000)) AS \"at\" FROM obs_interval WHERE start_utc <= end_utc)",
    "repeated_rows": "SELECT beacon_id, CAST(k AS INT) AS copy FROM beacon, unnest(range(1, beacon_id % 4 + 1)) u(k)",
    "sheet_values": """WITH v AS (SELECT *, agenda_id % 24 AS h, agenda_id % 60 AS m, CASE WHEN agenda_id % 7 = 2 THEN 0 ELSE agenda_id % 59 END AS s FROM agenda),
      t AS (SELECT *, 1767571200000 + ((h * 60 + m) * 60 + s) * 1000 AS a FROM v)
      SELECT agenda_id, CASE agenda_id % 7 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE a + CASE WHEN a < 1767578400000 THEN 86400000 ELSE 0 END END AS ms,
        CAST(next_hours * CASE WHEN agenda_id % 2 = 0 THEN 1000000 ELSE 60000000 END AS BIGINT) AS span_us, CASE WHEN agenda_id % 5 = 0 THEN 0 ELSE coalesce(CAST(trunc(uplink_dur_min) AS INT), 0) END AS number FROM t""",
    "file_chunks": f"WITH {_FILES} SELECT doc_id, chunk, \"offset\", data_hex FROM pieces",
    "file_uplink_hex": _uplink("'CTS1+bulkup16(' || data_hex || ')'", True),
    "file_uplink_base64": _uplink("'CTS1+bulkup64(' || to_base64(unhex(data_hex)) || ')'", False),
    "file_writes": f"""WITH {_FILES}, named AS (SELECT doc_id, 'store_' || doc_id AS target, n, content FROM files)
      SELECT doc_id, 1 AS phase, CAST(0 AS BIGINT) AS step, 'CTS1+config_set_int_var(TCMD_require_unique_tssent,1)!' AS line FROM named
      UNION ALL SELECT doc_id, 3, chunk, 'CTS1+fs_write_file_hex(store_' || doc_id || ',' || "offset" || ',' || data_hex || ')!' FROM pieces
      UNION ALL SELECT doc_id, 5, k, 'CTS1+fs_read_file_sha256_hash_json(' || target || ',0,0)!' FROM named, (VALUES (0), (1)) v(k)
      UNION ALL SELECT doc_id, 6, 0, '# SHA256 of input file: ' || sha256(content) || ' (' || format('{{:,}}', n) || ' bytes)' FROM named
      UNION ALL SELECT doc_id, 6, v.s, replace(replace(v.l, '<d>', CAST(doc_id AS VARCHAR)), '<t>', target) FROM named, (VALUES (1, '# Generated with arguments:'), (2, '#   input_file.name=doc_<d>'), (3, '#   satellite_file=<t>'), (4, '#   chunk_size=96'), (5, '#   tssent_start_val=None'), (6, '#   tssent_interval_ms=1000'), (7, '#   tsexec_start_val=None'), (8, '#   tsexec_interval_ms=30000'), (9, '#   mode=write_file_hex')) v(s, l)""",
}
try:
    _INFO = "'Observation ' || id || ' | GS ' || ground_station_id || ' @ ' || coalesce(CAST(station_lat AS VARCHAR), '?') || ', ' || coalesce(CAST(station_lng AS VARCHAR), '?') || ' (in ' || coalesce(country, 'None') || ') | Observer: ' || coalesce(observer, '?')"
    ORACLE["pass_agenda"] = f"""WITH {_PASSES}, {coverage_queries._countries('passes')}, told AS (SELECT * FROM changes LEFT JOIN countries USING (station_lat, station_lng)), {_remarks(_INFO).replace('FROM changes', 'FROM told')},
      lines AS (SELECT observer, 0 AS phase, p AS a, 0 AS b, 0 AS c, l AS line FROM spans, (VALUES {_listed(_HEAD, 0)}, {_listed(_MORE, 6)}) v(p, l)
        UNION ALL SELECT observer, 0, 5, 0, 0, '# Valid observations: ' || n_valid FROM spans
        UNION ALL SELECT observer, 1, p, 0, 0, l FROM spans, (VALUES (-1, '# PRIORITY COMMANDS'), (2, '')) v(p, l)
        UNION ALL SELECT observer, 1, i, 0, 0, {_line('cmd', f'{_START} + i * 1000', 'x')} FROM spans, (VALUES (0, 'set_mode(2)', 1767600000000), (1, 'reboot()', 0)) c(i, cmd, x)
        UNION ALL SELECT observer, 2, 0, 0, 0, '# Timeline start: ' || strftime(make_timestamp(first * 1000), '%Y-%m-%d %H:%M:%S UTC') FROM spans UNION ALL SELECT observer, 2, 1, 0, 0, '' FROM spans
        UNION ALL SELECT observer, 3, t, -1, ordinal, line FROM remarks
        UNION ALL SELECT observer, 3, t_ms, 2 * n, position, line FROM priorities UNION ALL SELECT observer, 3, t_ms, 2 * n + 1, 0, line FROM commands)
      SELECT observer, row_number() OVER (PARTITION BY observer ORDER BY phase, a, b, c) AS line_no, line FROM lines"""
except FileNotFoundError:  # no zone tables on this machine, so no countries
    QUERIES.pop("pass_agenda")
