"""Queries of the general problems 1 to 6, with the parameters TESTDATA.md states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundlake.operators import interval_map, late, rejects, spikes, timestamps
from groundlake.operators.redelivery import MessageArchive, packet_copies
from groundlake.plans.tables import table
from groundlake.session import new_folder
from groundlake.streaming import streams

#: fixed values: what a satellite can have, per field
LIMITS = {"eps_battery_voltage_mv": (5000, 9500), "obc_temperature_cc": (-6000, 10000), "eps_battery_temperature_0_cc": (-6000, 10000)}
LONGEST_GAP_US = 12 * 3_600_000_000


def _archive(spark: SparkSession, folder: str) -> MessageArchive:
    """First deliveries (live and archive sessions) as history, then the other uploads as an incoming batch."""
    packets = table(spark, folder, "packet")
    first = F.coalesce(F.col("session_dir").rlike("/(archive|live)/[0-9]+/?$"), F.lit(False))
    archive = MessageArchive(spark, new_folder(spark, "archive"))
    archive.merge(packet_copies(packets.filter(first)))
    archive.merge(packet_copies(packets.filter(~first)))
    return archive


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _archive(spark, folder).copies().filter("superfluous").select(F.col("row_id").alias("packet_id"))


def p1_kept(spark: SparkSession, folder: str) -> DataFrame:
    return _archive(spark, folder).copies().filter("NOT superfluous").select(F.col("row_id").alias("packet_id"), F.timestamp_micros("ts").cast("timestamp_ntz").alias("ts_received"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.faults(rejects.parse_lines(table(spark, folder, "packet_line")))


def p2_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.loaded(rejects.parse_lines(table(spark, folder, "packet_line")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return timestamps.normalised(table(spark, folder, "agenda"))


def _voltage_states(spark: SparkSession, folder: str) -> DataFrame:
    usable = late.usable_events(table(spark, folder, "beacon"), table(spark, folder, "packet"), ["satellite_name", "eps_battery_voltage_mv"])
    return late.revisions(usable, "satellite_name", "eps_battery_voltage_mv")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    out = late.corrected(_voltage_states(spark, folder))
    return out.select(F.col("entity").alias("satellite_name"), (F.col("start_us") / 1000).cast("bigint").alias("hour_start_ms"))


def p4_revisions(spark: SparkSession, folder: str) -> DataFrame:
    return _voltage_states(spark, folder).selectExpr("entity AS satellite_name", "CAST(start_us / 1000 AS bigint) AS hour_start_ms", "revision", "n_new", "n_events", "value_sum AS voltage_sum_mv", "n_values")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    out = interval_map.gaps(table(spark, folder, "obs_interval"), "ground_station_id", "start_utc", "end_utc", LONGEST_GAP_US)
    ms = lambda c: F.floor(F.col(c) / F.lit(1000)).cast("bigint").alias(f"{c}_ms")
    return out.select(F.col("entity").alias("ground_station_id"), ms("gap_start"), ms("gap_end"))


def p5_periods(spark: SparkSession, folder: str) -> DataFrame:
    out = interval_map.periods(table(spark, folder, "obs_interval"), "ground_station_id", "start_utc", "end_utc")
    return out.selectExpr("entity AS ground_station_id", "period_start AS start_us", "period_end AS end_us")


def interval_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """All gaps of every station, as a stream leaves them that gets the intervals in four parts and out of order."""
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # each holds a store of its own
    wanted = {streams.STORE: streams.ROCKSDB, "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    parts, out, state = (new_folder(spark, n) for n in ("parts", "changes", "state"))
    rows = table(spark, folder, "obs_interval").select("observation_id", "ground_station_id", "start_utc", "end_utc")
    for k in range(4):
        rows.filter(F.pmod(F.xxhash64("observation_id"), F.lit(4)) == k).drop("observation_id").write.parquet(f"{parts}/part={k}")
    schema = "entity string, gap_start bigint, gap_end bigint, added boolean"
    spark.createDataFrame([], schema).write.parquet(f"{out}/none")
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        source = spark.readStream.schema("ground_station_id string, start_utc timestamp_ntz, end_utc timestamp_ntz, part int").option("maxFilesPerTrigger", 1).parquet(parts)
        changes = streams.interval_stream(source, "ground_station_id", "start_utc", "end_utc")
        query = changes.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True)
        query.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/{number}")).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    told = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    net = told.groupBy("entity", "gap_start", "gap_end").agg(F.sum(F.when(F.col("added"), 1).otherwise(-1)).alias("n")).filter("n > 0")
    return net.select(F.col("entity").alias("ground_station_id"), F.col("gap_start").alias("gap_start_us"), F.col("gap_end").alias("gap_end_us"))


def session_periods(spark: SparkSession, folder: str) -> DataFrame:
    """The merged periods of intervals that last, by session windows."""
    out = streams.session_periods(table(spark, folder, "obs_interval"), "ground_station_id", "start_utc", "end_utc")
    return out.selectExpr("entity AS ground_station_id", "period_start AS start_us", "period_end AS end_us", "n_intervals")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    usable = late.usable_events(table(spark, folder, "beacon"), table(spark, folder, "packet"), ["satellite_name", "beacon_id", *LIMITS])
    return spikes.implausible(usable, "satellite_name", "beacon_id", LIMITS)


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p2_found, p2_loaded, p3_found, p4_found, p4_revisions, p5_found, p5_periods, interval_gaps, session_periods, p6_found)}

_USABLE = """usable AS (
  SELECT b.*, epoch_us(p.ts_received) AS received_us, b.unix_epoch_time_ms * 1000 AS event_us,
         b.unix_epoch_time_ms - b.unix_epoch_time_ms % 3600000 AS hour_start_ms
  FROM beacon b JOIN packet p USING (packet_id)
  WHERE b.unix_epoch_time_ms >= 1577836800000 AND b.unix_epoch_time_ms * 1000 <= epoch_us(p.ts_received) + 600000000)"""
_PERIODS = """valid AS (
  SELECT ground_station_id, epoch_us(start_utc) AS lo, epoch_us(end_utc) AS hi FROM obs_interval
  WHERE ground_station_id <> '?' AND start_utc <= end_utc),
reach AS (SELECT *, max(hi) OVER (PARTITION BY ground_station_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM valid),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY ground_station_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM reach),
periods AS (SELECT ground_station_id, k, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY ALL)"""
_REASON = r"""split AS (
  SELECT line_id, regexp_replace(regexp_replace(raw_line, '^\x{FEFF}', ''), '\r$', '') AS l FROM packet_line),
quoted AS (
  SELECT line_id, regexp_full_match(l, '(?s)("([^"]|"")*"|[^"|]*)(\|("([^"]|"")*"|[^"|]*))*') AS fine,
         regexp_extract(l, '(?s)^("(?:[^"]|"")*"|[^"|]*)\|("(?:[^"]|"")*"|[^"|]*)\|("(?:[^"]|"")*"|[^"|]*)\|("(?:[^"]|"")*"|[^"|]*)$', ['a', 'b', 'c', 'd']) AS f,
         regexp_full_match(l, '(?s)("([^"]|"")*"|[^"|]*)\|("([^"]|"")*"|[^"|]*)\|("([^"]|"")*"|[^"|]*)\|("([^"]|"")*"|[^"|]*)') AS four FROM split),
plain AS (
  SELECT line_id, fine, four,
         CASE WHEN f.a[1] = '"' THEN replace(f.a[2:-2], '""', '"') ELSE f.a END AS t, regexp_replace(CASE WHEN f.b[1] = '"' THEN replace(f.b[2:-2], '""', '"') ELSE f.b END, '[ \t]', '', 'g') AS p,
         CASE WHEN f.c[1] = '"' THEN replace(f.c[2:-2], '""', '"') ELSE f.c END AS o, CASE WHEN f.d[1] = '"' THEN replace(f.d[2:-2], '""', '"') ELSE f.d END AS g FROM quoted),
judged AS (
  SELECT *, CASE WHEN NOT fine THEN 'quoting' WHEN NOT four THEN 'columns'
    WHEN NOT regexp_full_match(t, '\d{4}-\d\d-\d\d[T ]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)?') OR t < '0001' OR try_cast(t[1:10] AS date) IS NULL THEN 'timestamp'
    WHEN NOT regexp_full_match(p, '([0-9A-Fa-f]{2}){5,}') THEN 'payload'
    WHEN NOT regexp_full_match(o, '\d*') OR (o <> '' AND try_cast(o AS bigint) IS NULL) THEN 'observation' END AS reason FROM plain)"""

#: messages by equal header fields and payload less a valid trailer; anchors are chained, each the first copy beyond the horizon
_COPIES = f"""counted AS (SELECT packet_id, epoch_us(ts_received) AS ts, [csp_prio, csp_src, csp_dst, csp_dport, csp_sport, csp_flags] AS header, hex(payload) AS h, octet_length(payload) AS n,
    lower(lpad(to_hex(((((CAST(csp_prio & 3 AS BIGINT) * 32 + (csp_src & 31)) * 32 + (csp_dst & 31)) * 64 + (csp_dport & 63)) * 64 + (csp_sport & 63)) * 256 + (csp_flags & 255)), 8, '0')) || lower(hex(payload)[:greatest(0, 2 * octet_length(payload) - 8)]) AS body
    FROM packet WHERE rs_errs >= 0 AND payload IS NOT NULL AND ts_received IS NOT NULL),
  crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0x82F63B78}) ELSE c >> 1 END)) AS t),
  valid AS (SELECT counted.*, coalesce(n >= 4 AND xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(body) // 2), lambda k: CAST('0x' || substr(body, 2 * k + 1, 2) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) = CAST('0x' || substr(h, 2 * n - 7, 8) AS BIGINT), false) AS trailer FROM counted, crc_table),
  messages AS (SELECT packet_id, ts, header, CASE WHEN trailer THEN h[:2 * n - 8] ELSE h END AS core FROM valid),
  anchors AS (SELECT header, core, min(ts) AS anchor FROM messages GROUP BY ALL
    UNION ALL SELECT a.header, a.core, (SELECT min(m.ts) FROM messages m WHERE m.header = a.header AND m.core = a.core AND m.ts > a.anchor + 600000000) AS next FROM anchors a WHERE next IS NOT NULL),
  placed AS (SELECT m.*, a.anchor, row_number() OVER (PARTITION BY m.header, m.core, a.anchor ORDER BY m.ts, m.packet_id) AS k FROM messages m ASOF JOIN anchors a ON m.header = a.header AND m.core = a.core AND m.ts >= a.anchor)"""

ORACLE = {
    "p1_found": f"WITH RECURSIVE {_COPIES} SELECT packet_id FROM placed WHERE k > 1",
    "p1_kept": f"WITH RECURSIVE {_COPIES} SELECT packet_id, make_timestamp(ts) AS ts_received FROM placed WHERE k = 1",
    "p2_found": f"WITH {_REASON} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p2_loaded": rf"""WITH {_REASON},
      parts AS (SELECT *, regexp_extract(t, '([+-])(\d\d):(\d\d)$', ['s', 'h', 'm']) AS z, regexp_extract(t, '\.(\d+)', 1) AS frac FROM judged WHERE reason IS NULL)
      SELECT line_id, epoch_us(CAST(replace(t[1:19], 'T', ' ') AS timestamp)) + CAST(rpad(frac[1:6], 6, '0') AS bigint)
        - CASE WHEN z.s = '' THEN 0 ELSE (CASE WHEN z.s = '-' THEN -1 ELSE 1 END) * (try_cast(z.h AS bigint) * 60 + try_cast(z.m AS bigint)) * 60000000 END AS received_us,
        lower(p) AS payload_hex, try_cast(o AS bigint) AS observation_id, g AS ground_station FROM parts""",
    "p4_found": f"WITH {_USABLE} SELECT DISTINCT satellite_name, hour_start_ms FROM usable WHERE received_us > hour_start_ms * 1000 + 4200000000 AND received_us <= hour_start_ms * 1000 + 25200000000",
    "p4_revisions": f"""WITH {_USABLE},
      cells AS (SELECT satellite_name, hour_start_ms, CAST(greatest(0, ceil((received_us - hour_start_ms * 1000 - 4200000000) / 600000000.0)) AS int) AS revision,
                       count(*) AS n_new, sum(eps_battery_voltage_mv) AS s, count(eps_battery_voltage_mv) AS c
                FROM usable WHERE received_us <= hour_start_ms * 1000 + 25200000000 GROUP BY ALL)
      SELECT satellite_name, hour_start_ms, revision, n_new, CAST(sum(n_new) OVER w AS bigint) AS n_events, CAST(sum(s) OVER w AS bigint) AS voltage_sum_mv, CAST(sum(c) OVER w AS bigint) AS n_values
      FROM cells WINDOW w AS (PARTITION BY satellite_name, hour_start_ms ORDER BY revision ROWS UNBOUNDED PRECEDING)""",
    "p5_found": f"""WITH {_PERIODS}, nexts AS (SELECT *, lead(lo) OVER (PARTITION BY ground_station_id ORDER BY lo) AS then_lo FROM periods)
      SELECT ground_station_id, hi // 1000 AS gap_start_ms, then_lo // 1000 AS gap_end_ms FROM nexts WHERE then_lo > hi AND then_lo - hi <= 43200000000""",
    "interval_gaps": f"WITH {_PERIODS}, nexts AS (SELECT *, lead(lo) OVER (PARTITION BY ground_station_id ORDER BY lo) AS then_lo FROM periods) SELECT ground_station_id, hi AS gap_start_us, then_lo AS gap_end_us FROM nexts WHERE then_lo > hi",
    "session_periods": f"WITH {_PERIODS.replace('start_utc <= end_utc', 'start_utc < end_utc')}, counted AS (SELECT ground_station_id, k, count(*) AS n FROM numbered GROUP BY ALL) SELECT ground_station_id, lo AS start_us, hi AS end_us, n AS n_intervals FROM periods JOIN counted USING (ground_station_id, k)",
    "p5_periods": f"WITH {_PERIODS} SELECT ground_station_id, lo AS start_us, hi AS end_us FROM periods",
}
