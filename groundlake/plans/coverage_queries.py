"""Coverage queries over obs_interval: by observer, and the reports over the whole network as one group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundlake.functions.ordered import running_sums
from groundlake.operators import coverage
from groundlake.plans.tables import table
from groundlake.session import written
from groundlake.sources import places

#: The group whose stations are merged, here an observer's.
KEYS = ["observer"]
ZONE = "Asia/Kolkata"


def _members(spark: SparkSession, folder: str, keys: list[str] = KEYS) -> DataFrame:
    raw = table(spark, folder, "obs_interval").dropDuplicates(["observation_id", "start_utc", "end_utc", "ground_station_id"])
    rows = coverage.observations(raw, "start_utc", "end_utc", "ground_station_id", "observation_id", keep=("observer", "station_lat", "station_lng"))
    good, _ = coverage.split_rejects(rows)
    day = F.floor(F.unix_micros("start") / F.lit(86_400_000_000)).cast("bigint")
    numbered = running_sums(good, keys, day, ["start", "end", "id", "ground_station"], {"ordinal": F.lit(1)})
    return written(coverage.assign_windows(written(numbered, "numbered"), keys), "members")


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.windows(_members(spark, folder), KEYS)


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if f.dataType.simpleString() == "timestamp"})


def coverage_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _ntz(_windows(spark, folder).select("observer", "window_no", "start", "end", "duration_s", "stations", "n_observations"))


def coverage_members(spark: SparkSession, folder: str) -> DataFrame:
    """The observations of each window, in order."""
    return coverage.placed(_members(spark, folder), KEYS).select("observer", "window_no", F.col("member_no").cast("bigint").alias("member_no"), "id")


def coverage_peaks(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.peaks(_members(spark, folder), KEYS)


def coverage_order(spark: SparkSession, folder: str) -> DataFrame:
    """Windows with at least two stations at once, by falling peak and start, with their place in that order."""
    found = coverage.filtered(coverage.windows(_members(spark, folder, []), []), 2, "stations")
    return _ntz(running_sums(found, [], -F.col("peak"), [F.desc("peak"), "start"], {"place": F.lit(1)}).select(F.col("place").cast("bigint").alias("place"), "peak", "start"))


def coverage_summary(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.shown(coverage.filtered(coverage.windows(_members(spark, folder), KEYS, ids=True), 2, "stations"), ids=True)


def coverage_totals(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.totals(_windows(spark, folder))


def coverage_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report's text over the whole network: title, table and footer."""
    return coverage.summary_lines(coverage.windows(_members(spark, folder, []), []), 2)


def coverage_detail(spark: SparkSession, folder: str) -> DataFrame:
    members = _members(spark, folder)
    return coverage.detail(coverage.windows(members, KEYS), members, KEYS)


def coverage_rejects(spark: SparkSession, folder: str) -> DataFrame:
    rows = coverage.observations(table(spark, folder, "obs_interval"), "start_utc", "end_utc", "ground_station_id", "observation_id")
    return coverage.split_rejects(rows)[1].groupBy("ground_station").agg(F.count("*").alias("n"))


def coverage_steps(spark: SparkSession, folder: str) -> DataFrame:
    return _ntz(coverage.steps(_members(spark, folder), KEYS))


def coverage_countries(spark: SparkSession, folder: str) -> DataFrame:
    """The leading countries among active observations after each event."""
    located = coverage.with_country(_members(spark, folder), places.gazetteer(spark), places.country_names(spark), "station_lat", "station_lng")
    return _ntz(coverage.leading_countries(located, KEYS))


def nearest_stations(spark: SparkSession, folder: str) -> DataFrame:
    """The station nearest to each observation's coordinates."""
    known = table(spark, folder, "ground_station").select(F.col("station_lat").alias("place_lat"), F.col("station_lng").alias("place_lng"), F.col("ground_station_id").alias("code"))
    rows = table(spark, folder, "obs_interval").select("station_lat", "station_lng").filter("station_lat IS NOT NULL").distinct()
    return coverage.nearest_place(rows, known, "station_lat", "station_lng").withColumnRenamed("code", "nearest_station_id")


def _located(spark: SparkSession, folder: str) -> DataFrame:
    """Observations with times as ISO text and the country of their station."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    raw = table(spark, folder, "obs_interval").select(F.col("observation_id").alias("id"), F.col("ground_station_id").alias("ground_station"), iso("start_utc").alias("start"), iso("end_utc").alias("end"), "station_lat", "station_lng", "observer")
    return coverage.with_country(raw, places.gazetteer(spark), places.country_names(spark), "station_lat", "station_lng")


def station_countries(spark: SparkSession, folder: str) -> DataFrame:
    """The country of each ground station, by the nearest place of the gazetteer."""
    rows = table(spark, folder, "ground_station").select("ground_station_id", "station_lat", "station_lng")
    return coverage.with_country(rows, places.gazetteer(spark), places.country_names(spark), "station_lat", "station_lng").select("ground_station_id", "country")


def observation_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Display rows of observations given as ISO text."""
    return coverage.display_rows(_located(spark, folder), F.lit("2026-01-06T00:00:00Z").cast("timestamp"), ZONE, "country")


def observation_info(spark: SparkSession, folder: str) -> DataFrame:
    return _located(spark, folder).select("id", coverage.info_text(F.col("country")).alias("info"))


QUERIES = {f.__name__: f for f in (coverage_windows, coverage_members, coverage_peaks, coverage_order, coverage_summary, coverage_totals, coverage_report, coverage_rejects, coverage_steps, coverage_detail, coverage_countries, nearest_stations, station_countries, observation_rows, observation_info)}

_MEMBERS = """distinct_rows AS (SELECT DISTINCT ON (observation_id, start_utc, end_utc, ground_station_id) * FROM obs_interval),
good AS (SELECT observer, station_lat, station_lng, start_utc AS s, end_utc AS e, coalesce(ground_station_id, '?') AS g, coalesce(CAST(observation_id AS VARCHAR), '?') AS id FROM distinct_rows WHERE end_utc >= start_utc),
placed AS (SELECT *, row_number() OVER (PARTITION BY observer ORDER BY s, e, id, g) AS o FROM good),
reached AS (SELECT *, max(e) OVER (PARTITION BY observer ORDER BY s, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM placed),
members AS (SELECT *, CAST(sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY observer ORDER BY s, o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS window_no FROM reached),
events AS (SELECT observer, window_no, s AS t, 1 AS d FROM members UNION ALL SELECT observer, window_no, e, -1 FROM members),
running AS (SELECT *, sum(d) OVER (PARTITION BY observer, window_no ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM events),
peaks AS (SELECT observer, window_no, CAST(greatest(0, max(n)) AS BIGINT) AS peak FROM running GROUP BY ALL),
wins AS (SELECT observer, window_no, min(s) AS s, max(e) AS e, count(DISTINCT g) AS stations, count(*) AS n_observations, string_agg(id, ', ' ORDER BY s, o) AS obs_ids FROM members GROUP BY ALL),
full_wins AS (SELECT w.*, p.peak, (epoch_us(e) - epoch_us(s)) // 1000000 AS duration_s FROM wins w JOIN peaks p USING (observer, window_no))"""
_NETWORK = _MEMBERS.replace("PARTITION BY observer, window_no ORDER", "PARTITION BY window_no ORDER").replace("PARTITION BY observer ORDER", "ORDER").replace("SELECT observer, window_no,", "SELECT window_no,").replace("USING (observer, window_no)", "USING (window_no)")
_DURATION = "(duration_s // 60) || 'm ' || (duration_s % 60) || 's'"
_T = "'%Y-%m-%dT%H:%M:%S'"
_END = f"CASE WHEN CAST(s AS DATE) = CAST(e AS DATE) THEN strftime(e, '%H:%M:%S') ELSE strftime(e, {_T}) END"
_SPAN = """CASE WHEN us IS NULL THEN 'N/A' ELSE
  CASE WHEN abs(us) // 86400000000 = 1 THEN '1 day, ' WHEN abs(us) // 86400000000 > 1 THEN (abs(us) // 86400000000) || ' days, ' ELSE '' END
  || (abs(us) % 86400000000 // 3600000000) || ':' || lpad(CAST(abs(us) // 60000000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(us) // 1000000 % 60 AS VARCHAR), 2, '0')
  || CASE WHEN abs(us) % 1000000 > 0 THEN '.' || lpad(CAST(abs(us) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || CASE WHEN us < 0 THEN ' ago' ELSE '' END END"""
_STEPS = """ev AS (SELECT observer, s AS t, 1 AS d, o * 2 AS k, station_lat, station_lng FROM members UNION ALL SELECT observer, e, -1, o * 2 + 1, station_lat, station_lng FROM members),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY observer ORDER BY t, k) AS INT) AS event_no, sum(d) OVER (PARTITION BY observer ORDER BY t, k ROWS UNBOUNDED PRECEDING) AS n FROM ev)"""
_FAR = "pow(sin(radians(g.station_lat - q.station_lat) / 2), 2) + cos(radians(q.station_lat)) * cos(radians(g.station_lat)) * pow(sin(radians(g.station_lng - q.station_lng) / 2), 2)"


_POINT = r"^([+-])(\d{2})(\d{2})(\d{2})?([+-])(\d{3})(\d{2})(\d{2})?$"


def _countries(points: str) -> str:
    """SQL of ``countries``: the country of each (station_lat, station_lng) of a table, from the zone tables themselves."""
    zone, iso = (places.table_path(n) for n in ("zone.tab", "iso3166.tab"))
    angle = lambda sign, d, m, s: f"(CASE p[{sign}] WHEN '-' THEN -1 ELSE 1 END * (CAST(p[{d}] AS INT) + CAST(p[{m}] AS INT) / 60.0 + coalesce(try_cast(nullif(p[{s}], '') AS INT), 0) / 3600.0))"
    lines = lambda path: f"(SELECT string_split(l, chr(9)) AS f FROM (SELECT unnest(string_split(content, chr(10))) AS l FROM read_text('{path}')) WHERE l <> '' AND l[1] <> '#')"
    return f"""placed_zones AS (SELECT f[1] AS code, [{', '.join(f"regexp_extract(f[2], '{_POINT}', {k})" for k in range(1, 9))}] AS p FROM {lines(zone)}),
  gazetteer AS (SELECT code, {angle(1, 2, 3, 4)} AS station_lat, {angle(5, 6, 7, 8)} AS station_lng FROM placed_zones),
  nearest AS (SELECT q.station_lat, q.station_lng, arg_min(g.code, ({_FAR}, g.code)) AS code FROM (SELECT DISTINCT station_lat, station_lng FROM {points} WHERE station_lat IS NOT NULL AND station_lng IS NOT NULL) q, gazetteer g GROUP BY ALL),
  countries AS (SELECT n.station_lat, n.station_lng, i.f[2] AS country FROM nearest n LEFT JOIN {lines(iso)} i ON n.code = i.f[1])"""


_CELLS = {"a": "CAST(stations AS VARCHAR)", "b": f"strftime(s, {_T})", "c": _END, "d": _DURATION}
_NAMES = {"a": "Stations", "b": "Start (UTC)", "c": "End (UTC)", "d": "Duration"}
_centred = lambda text, w: f"repeat(' ', CAST(ceil(({w} - length({text})) / 2.0) AS BIGINT)) || {text} || repeat(' ', CAST(floor(({w} - length({text})) / 2.0) AS BIGINT))"
_rule = lambda a, f, m, z: f"'{a}' || " + f" || '{m}' || ".join(f"repeat('{f}', w{k} + 2)" for k in _CELLS) + f" || '{z}'"
_row = lambda of: "'│ ' || " + " || ' ┆ ' || ".join(_centred(of(k), f"w{k}") for k in _CELLS) + " || ' │'"
ORACLE = {
    "coverage_windows": f"WITH {_MEMBERS} SELECT observer, window_no, s AS start, e AS end, duration_s, stations, n_observations FROM full_wins",
    "coverage_members": f"WITH {_MEMBERS} SELECT observer, window_no, row_number() OVER (PARTITION BY observer, window_no ORDER BY s, o) AS member_no, id FROM members",
    "coverage_peaks": f"WITH {_MEMBERS} SELECT * FROM peaks",
    "coverage_order": f"WITH {_NETWORK} SELECT row_number() OVER (ORDER BY peak DESC, s) AS place, peak, s AS start FROM full_wins WHERE peak >= 2",
    "coverage_summary": f"WITH {_MEMBERS} SELECT stations AS total_stations, strftime(s, {_T}) AS window_start_utc, {_END} AS window_end_utc, {_DURATION} AS duration, obs_ids FROM full_wins WHERE peak >= 2",
    "coverage_totals": f"WITH {_MEMBERS} SELECT count(*) AS n_windows, CAST(sum(duration_s) AS BIGINT) AS total_s, max(peak) AS max_peak FROM full_wins",
    "coverage_report": f"""WITH {_NETWORK}, kept AS (SELECT *, row_number() OVER (ORDER BY s) AS k, {', '.join(f'{v} AS {k}' for k, v in _CELLS.items())} FROM full_wins WHERE peak >= 2),
      widths AS (SELECT {', '.join(f"greatest({len(_NAMES[k])}, max(length({k}))) AS w{k}" for k in _CELLS)}, count(*) AS n, CAST(sum(duration_s) AS BIGINT) AS t, max(peak) AS p FROM kept)
      SELECT CAST(0 AS BIGINT) AS seq, 'Combined Coverage Windows (UTC)' AS line UNION ALL SELECT 1, repeat('─', 80)
      UNION ALL SELECT 2, {_rule('┌', '─', '┬', '┐')} FROM widths UNION ALL SELECT 3, {_row(lambda k: f"'{_NAMES[k]}'")} FROM widths UNION ALL SELECT 4, {_rule('╞', '═', '╪', '╡')} FROM widths
      UNION ALL SELECT k + 4, {_row(lambda k: k)} FROM kept, widths
      UNION ALL SELECT {2**62}, {_rule('└', '─', '┴', '┘')} FROM widths
      UNION ALL SELECT {2**62 + 1}, '  ' || n || ' window(s)  |  Total coverage: ' || (t // 3600) || 'h ' || (t % 3600 // 60) || 'm ' || (t % 60) || 's  |  ' || p || ' simultaneous station(s)' FROM widths""",
    "coverage_rejects": "SELECT coalesce(ground_station_id, '?') AS ground_station, count(*) AS n FROM obs_interval WHERE NOT coalesce(end_utc >= start_utc, false) GROUP BY ALL",
    "coverage_steps": f"WITH {_MEMBERS}, {_STEPS} SELECT observer, event_no, p AS point, t, CAST(CASE WHEN p = 0 THEN n - d ELSE n END AS BIGINT) AS n FROM numbered, (VALUES (0), (1)) v(p)",
    "coverage_detail": f"""WITH {_MEMBERS}, rows AS (SELECT *, CAST(row_number() OVER (PARTITION BY observer ORDER BY s) AS INT) AS row_no FROM full_wins)
      SELECT observer, row_no, CAST(0 AS BIGINT) AS member_no, 'Window ' || lpad(CAST(row_no AS VARCHAR), 3, ' ') || '  |  up to ' || peak || ' stn (peak)  |  ' || strftime(s, {_T}) || ' → ' || {_END} || '  |  ' || {_DURATION} AS line FROM rows
      UNION ALL SELECT observer, row_no, row_number() OVER (PARTITION BY observer, row_no ORDER BY s, o), '          Obs ' || id || repeat(' ', greatest(0, 8 - length(id))) || '  GS ' || g || repeat(' ', greatest(0, 5 - length(g))) || '  ' || strftime(s, '%H:%M:%SZ') || ' → ' || strftime(e, '%H:%M:%SZ') || '  (' || {_DURATION} || ')'
      FROM (SELECT m.*, r.row_no, (epoch_us(m.e) - epoch_us(m.s)) // 1000000 AS duration_s FROM members m JOIN rows r USING (observer, window_no))
      UNION ALL SELECT DISTINCT observer, x.r, x.m, x.l FROM rows, (VALUES (0, 0, repeat('═', 80)), (0, 1, 'Detailed Coverage Breakdown'), (0, 2, repeat('─', 80)), ({2**31 - 1}, 0, repeat('═', 80))) x(r, m, l)""",
    "nearest_stations": f"SELECT q.station_lat, q.station_lng, arg_min(ground_station_id, ({_FAR}, ground_station_id)) AS nearest_station_id FROM (SELECT DISTINCT station_lat, station_lng FROM obs_interval) q, ground_station g WHERE q.station_lat IS NOT NULL GROUP BY ALL",
}
try:
    ORACLE |= {
        "station_countries": f"WITH {_countries('ground_station')} SELECT ground_station_id, country FROM ground_station LEFT JOIN countries USING (station_lat, station_lng)",
        "coverage_countries": f"""WITH {_MEMBERS}, {_STEPS}, {_countries('members')}, located AS (SELECT * FROM numbered LEFT JOIN countries USING (station_lat, station_lng)),
          counted AS (SELECT *, sum(d) OVER (PARTITION BY observer, country ORDER BY event_no ROWS UNBOUNDED PRECEDING) AS c FROM located WHERE country IS NOT NULL),
          since AS (SELECT *, max(CASE WHEN c = 1 AND d = 1 THEN event_no END) OVER (PARTITION BY observer, country ORDER BY event_no ROWS UNBOUNDED PRECEDING) AS first, lead(event_no) OVER (PARTITION BY observer, country ORDER BY event_no) AS until FROM counted),
          ranked AS (SELECT l.observer, l.event_no, s.country, s.c, row_number() OVER (PARTITION BY l.observer, l.event_no ORDER BY s.c DESC, s.first) AS r FROM located l JOIN since s ON l.observer IS NOT DISTINCT FROM s.observer AND l.event_no >= s.event_no AND (s.until IS NULL OR l.event_no < s.until) AND s.c > 0),
          lists AS (SELECT observer, event_no, string_agg(country || ' (' || CAST(c AS BIGINT) || ')', ', ' ORDER BY r) AS countries FROM ranked WHERE r <= 5 GROUP BY ALL)
          SELECT l.observer, l.event_no, l.t, coalesce(x.countries, '(none)') AS countries FROM located l LEFT JOIN lists x ON l.observer IS NOT DISTINCT FROM x.observer AND l.event_no = x.event_no""",
        "observation_rows": f"""WITH {_countries('obs_interval')}, q AS (SELECT *, epoch_us(start_utc) - 1767657600000000 AS us FROM obs_interval LEFT JOIN countries USING (station_lat, station_lng))
          SELECT coalesce(CAST(observation_id AS VARCHAR), '?') AS id, coalesce(ground_station_id, '?') AS ground_station, coalesce(country, '?') AS country, coalesce(strftime(start_utc, '%Y-%m-%dT%H:%M:%SZ'), '?') AS start_utc, coalesce(strftime(end_utc, '%Y-%m-%dT%H:%M:%SZ'), '?') AS end_utc,
          coalesce(strftime(start_utc + INTERVAL 330 MINUTE, {_T}) || '+05:30', '?') AS start_local, coalesce(strftime(end_utc + INTERVAL 330 MINUTE, {_T}) || '+05:30', '?') AS end_local, {_SPAN} AS wait FROM q""",
        "observation_info": f"WITH {_countries('obs_interval')} SELECT observation_id AS id, 'Observation ' || coalesce(CAST(observation_id AS VARCHAR), '?') || ' | GS ' || coalesce(ground_station_id, '?') || ' @ ' || coalesce(CAST(station_lat AS VARCHAR), '?') || ', ' || coalesce(CAST(station_lng AS VARCHAR), '?') || ' (in ' || coalesce(country, 'None') || ') | Observer: ' || coalesce(observer, '?') AS info FROM obs_interval LEFT JOIN countries USING (station_lat, station_lng)",
    }
except FileNotFoundError:  # no zone tables on this machine: the four queries need a gazetteer of the caller's
    for _name in ("station_countries", "coverage_countries", "observation_rows", "observation_info"):
        QUERIES.pop(_name)
