"""Coverage windows of ground-station observations.

Overlapping or touching observations of a group (a satellite, or any key columns) merge into windows, with distinct
and peak simultaneous station counts. Running computations over a group are cut into time
blocks, so a hot group is many tasks (see ``functions.ordered``).

Defined results: rows with a null start or end, or end before start, are rejects; a null station or id reads "?";
repeated rows stay members each; ties of equal start keep input order by ``ordinal``.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundlake.functions.batches import laid_out, whole_groups
from groundlake.functions.ordered import maximum_before, running_sums
from groundlake.session import written

#: ISO 8601 with a zone, in extended or basic form
ISO = r"^(\d{4})-?(\d{2})-?(\d{2})[^0-9](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?(Z|[+-]\d{2}(?::?\d{2})?)$"


def iso_instant(text: Column) -> Column:
    """Timestamp of ISO text with a zone; null for text without one or that is no time. Digits beyond microseconds are cut."""
    part = lambda k, default="": F.coalesce(F.nullif(F.regexp_extract(text, ISO, k), F.lit("")), F.lit(default))
    zone = F.regexp_replace(F.regexp_replace(part(8), "^Z$", "+00:00"), r"^([+-]\d{2}):?(\d{2})?$", "$1:$2")
    zone = F.when(F.length(zone) == 4, F.concat(zone, F.lit("00"))).otherwise(zone)
    clock = F.concat_ws(":", part(4), part(5, "00"), part(6, "00"))
    whole = F.concat(F.concat_ws("-", part(1), part(2), part(3)), F.lit("T"), clock, F.lit("."), F.substring(part(7, "0"), 1, 6), zone)
    return F.when(text.rlike(ISO), F.try_to_timestamp(whole))


def observations(raw: DataFrame, start: str = "start", end: str = "end", station: str = "ground_station", id_: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., start, end, ground_station, id) from text or timestamps; unreadable times become null."""
    def time(c: str) -> Column:
        kind = raw.schema[c].dataType.simpleString()
        return iso_instant(F.col(c)) if kind == "string" else F.col(c).cast("timestamp")

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    return raw.select(*keep, time(start).alias("start"), time(end).alias("end"), text(station).alias("ground_station"), text(id_).alias("id"))


def split_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejects)."""
    good = F.coalesce(F.col("end") >= F.col("start"), F.lit(False))
    return rows.filter(good), rows.filter(~good)


def _day(c: str) -> Column:
    return F.floor(F.unix_micros(c) / F.lit(86_400_000_000)).cast("bigint")


def assign_windows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``window_no``, from 1 in each group by start. Needs start, end and a unique ``ordinal``."""
    rows = maximum_before(rows, keys, _day("start"), ["start", "ordinal"], "end", "_before")
    new = F.coalesce(F.col("start") > F.col("_before"), F.lit(True)).cast("int")
    return running_sums(rows, keys, _day("start"), ["start", "ordinal"], {"window_no": new}).drop("_before")


def peaks(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, window_no, peak): most stations at once; at equal times ends come before starts."""
    key = [*keys, "window_no"]
    events = members.select(*key, F.col("start").alias("t"), F.lit(1).alias("d")).unionByName(members.select(*key, F.col("end").alias("t"), F.lit(-1).alias("d")))
    events = running_sums(events, key, _day("t"), ["t", "d"], {"_n": F.col("d")})
    return events.groupBy(*key).agg(F.greatest(F.lit(0), F.max("_n")).cast("bigint").alias("peak"))


def windows(members: DataFrame, keys: list[str], ids: bool = False) -> DataFrame:
    """One row a window: start, end, duration in seconds, distinct stations, peak; ``ids`` adds the members' ids by start.

    The list of ids is one value of a row, so it suits windows that people read; ``placed`` gives them as rows.
    """
    key = [*keys, "window_no"]
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "ordinal", "id"))), lambda x: x["id"]), ", ").alias("obs_ids")
    each = members.groupBy(*key).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.countDistinct("ground_station").alias("stations"), F.count("*").alias("n_observations"), *([listed] if ids else []))
    each = each.withColumn("duration_s", F.floor((F.unix_micros("end") - F.unix_micros("start")) / F.lit(1_000_000)).cast("bigint"))
    return each.join(peaks(members, keys), key)


def placed(members: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``member_no``, from 1 in each window by start."""
    return running_sums(members, [*keys, "window_no"], _day("start"), ["start", "ordinal"], {"member_no": F.lit(1)})


def filtered(found: DataFrame, least_stations: int = 1, sort: str = "time") -> DataFrame:
    """Windows with a peak of at least ``least_stations``, by time or by falling peak, then start."""
    if sort not in ("time", "stations"):
        raise ValueError("sort: time or stations")
    out = found.filter(F.col("peak") >= least_stations)
    return out.orderBy("start") if sort == "time" else out.orderBy(F.desc("peak"), "start")


def totals(found: DataFrame) -> DataFrame:
    """(n_windows, total_s, max_peak)."""
    return found.agg(F.count("*").alias("n_windows"), F.coalesce(F.sum("duration_s"), F.lit(0)).alias("total_s"), F.max("peak").alias("max_peak"))


def duration_text(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("bigint")
    return F.concat(F.floor(whole / 60).cast("bigint").cast("string"), F.lit("m "), F.pmod(whole, F.lit(60)).cast("string"), F.lit("s"))


FULL, CLOCK = "yyyy-MM-dd'T'HH:mm:ss", "HH:mm:ss"
WIDTH = 80  # of dividers
NO_WINDOWS = "(no coverage windows match the filter criteria)"


def end_text() -> Column:
    """The end, without its date if that is the start's."""
    return F.when(F.to_date("start") == F.to_date("end"), F.date_format("end", CLOCK)).otherwise(F.date_format("end", FULL))


def shown(found: DataFrame, ids: bool = False) -> DataFrame:
    """Text columns of the summary table and of exports."""
    extra = [F.col("obs_ids")] if ids else []
    return found.select(F.col("stations").alias("total_stations"), F.date_format("start", FULL).alias("window_start_utc"), end_text().alias("window_end_utc"), duration_text(F.col("duration_s")).alias("duration"), *extra)


def footer_line(found: DataFrame) -> DataFrame:
    """(line) with the totals."""
    s = F.col("total_s")
    total = F.concat(F.floor(s / 3600).cast("bigint").cast("string"), F.lit("h "), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("bigint").cast("string"), F.lit("m "), F.pmod(s, F.lit(60)).cast("string"), F.lit("s"))
    return totals(found).select(F.concat(F.lit("  "), F.col("n_windows").cast("string"), F.lit(" window(s)  |  Total coverage: "), total, F.lit("  |  "), F.coalesce("max_peak", F.lit(0)).cast("string"), F.lit(" simultaneous station(s)")).alias("line"))


def summary_lines(found: DataFrame, least_stations: int = 1, sort: str = "time", ids: bool = False, title: str = "Combined Coverage Windows (UTC)") -> DataFrame:
    """(seq, line): title, divider, table with centred cells, and footer; one line if no window is left.

    The driver sees the widths of the columns. Cells are not cut.
    """
    kept = filtered(found, least_stations, sort)
    order = ["start"] if sort == "time" else [F.desc("peak"), "start"]
    names = ["Stations", "Start (UTC)", "End (UTC)", "Duration", *(["Obs IDs"] if ids else [])]
    cells = shown(kept, ids).columns
    text = kept.select("start", "peak", *[c.cast("string").alias(n) for n, c in zip(cells, _cells(ids), strict=True)])
    widest = text.agg(*[F.max(F.length(c)).alias(c) for c in cells]).head()
    if widest[0] is None:
        return found.sparkSession.createDataFrame([(0, NO_WINDOWS)], "seq bigint, line string")
    width = [max(len(n), widest[c]) for n, c in zip(names, cells, strict=True)]
    rule = lambda left, fill, middle, right: left + middle.join(fill * (w + 2) for w in width) + right
    centre = lambda v, w: (" " * -(-(w - len(v)) // 2) + v).ljust(w)
    row = lambda values: "│ " + " ┆ ".join(map(centre, values, width)) + " │"
    head = [title, "─" * WIDTH, rule("┌", "─", "┬", "┐"), row(names), rule("╞", "═", "╪", "╡")]
    lead = lambda c, w: F.ceil((F.lit(w) - F.length(c)) / 2).cast("int")
    centred = [F.rpad(F.concat(F.repeat(F.lit(" "), lead(c, w)), F.col(c)), w, " ") for c, w in zip(cells, width, strict=True)]
    body = running_sums(text, [], _day("start") if sort == "time" else -F.col("peak"), order, {"seq": F.lit(1)})
    body = body.select((F.col("seq") + len(head) - 1).alias("seq"), F.concat(F.lit("│ "), F.concat_ws(" ┆ ", *centred), F.lit(" │")).alias("line"))
    lines = found.sparkSession.createDataFrame(list(enumerate(head)), "seq bigint, line string").unionByName(body)
    last = F.lit(2**62)
    return lines.unionByName(found.sparkSession.range(1).select(last.alias("seq"), F.lit(rule("└", "─", "┴", "┘")).alias("line"))).unionByName(footer_line(kept).select((last + 1).alias("seq"), "line"))


def _cells(ids: bool) -> list[Column]:
    return [F.col("stations"), F.date_format("start", FULL), end_text(), duration_text(F.col("duration_s")), *([F.col("obs_ids")] if ids else [])]


def detail(found: DataFrame, members: DataFrame, keys: list[str], sort: str = "time") -> DataFrame:
    """(keys, row_no, member_no, line): for each group two heading lines (row_no 0), a header line (member_no 0) and a
    line for each member of each window, and a last divider.
    """
    order = [F.desc("peak"), "start"] if sort == "stations" else ["start"]
    numbered = running_sums(found, keys, -F.col("peak") if sort == "stations" else _day("start"), order, {"row_no": F.lit(1)})
    numbered = numbered.withColumn("row_no", F.col("row_no").cast("int"))
    head = F.concat_ws("  |  ", F.concat(F.lit("Window "), F.format_string("%3d", "row_no")), F.concat(F.lit("up to "), F.col("peak"), F.lit(" stn (peak)")), F.concat(F.date_format("start", FULL), F.lit(" → "), end_text()), duration_text(F.col("duration_s")))
    heads = numbered.select(*keys, "row_no", F.lit(0).cast("bigint").alias("member_no"), head.alias("line"))
    inside = placed(members, keys).join(numbered.select(*keys, "window_no", "row_no"), [*keys, "window_no"])
    seconds = (F.unix_micros("end") - F.unix_micros("start")) / F.lit(1_000_000)
    at = lambda c: F.date_format(c, "HH:mm:ss'Z'")
    line = F.concat(F.lit("          Obs "), F.format_string("%-8s", "id"), F.lit("  GS "), F.format_string("%-5s", "ground_station"), F.lit("  "), at("start"), F.lit(" → "), at("end"), F.lit("  ("), duration_text(seconds), F.lit(")"))
    frame = F.array(*[F.struct(F.lit(r).alias("row_no"), F.lit(m).cast("bigint").alias("member_no"), F.lit(x).alias("line")) for r, m, x in ((0, 0, "═" * WIDTH), (0, 1, "Detailed Coverage Breakdown"), (0, 2, "─" * WIDTH), (2**31 - 1, 0, "═" * WIDTH))])
    frames = found.select(*keys).distinct() if keys else found.sparkSession.range(1).select()
    frames = frames.select(*keys, F.explode(frame).alias("_f")).select(*keys, "_f.*")
    return frames.unionByName(heads).unionByName(inside.select(*keys, "row_no", "member_no", line.alias("line")))


def steps(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, event_no, point, t, n): two points an event, before and after it; ties by time keep input order."""
    events = members.select(*keys, F.col("start").alias("t"), F.lit(1).alias("d"), (F.col("ordinal") * 2).alias("_o"))
    events = events.unionByName(members.select(*keys, F.col("end").alias("t"), F.lit(-1).alias("d"), (F.col("ordinal") * 2 + 1).alias("_o")))
    events = running_sums(events, keys, _day("t"), ["t", "_o"], {"event_no": F.lit(1), "_n": F.col("d")})
    events = events.withColumn("event_no", F.col("event_no").cast("int"))
    points = F.array(F.struct(F.lit(0).alias("point"), (F.col("_n") - F.col("d")).alias("n")), F.struct(F.lit(1).alias("point"), F.col("_n").alias("n")))
    return events.select(*keys, "event_no", "t", F.explode(points).alias("_p")).select(*keys, "event_no", "_p.point", "t", F.col("_p.n").cast("bigint").alias("n"))


def leading_countries(members: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """(keys, event_no, t, countries): after each event, the ``top`` most frequent countries of active observations.

    Ties go to the country that became active first. Needs ``country``; null ones count in no list. Groups are cut into
    days: what is active when a day begins comes from one summary row a country and day, and a day's events are then
    counted on in order, so there is a row an event and no list of all countries is kept for each.
    """
    base = members.select(*keys, "start", "end", "ordinal", "country")
    both = F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d"), (F.col("ordinal") * 2).alias("_o")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d"), (F.col("ordinal") * 2 + 1).alias("_o"))))
    events = base.select(*keys, "country", both.alias("_e")).select(*keys, "country", "_e.*")
    events = running_sums(events, keys, _day("t"), ["t", "_o"], {"event_no": F.lit(1)})
    events = written(events.select(*keys, "country", "t", "d", F.col("event_no").cast("int").alias("event_no"), _day("t").alias("_day")), "events")
    known = running_sums(events.filter("country IS NOT NULL"), [*keys, "country"], F.col("_day"), ["event_no"], {"_n": F.col("d")})
    state = known.groupBy(*keys, "country", "_day").agg(F.max_by("_n", "event_no").alias("_n"), F.max(F.when((F.col("_n") == 1) & (F.col("d") == 1), F.col("event_no"))).alias("_since"))
    of = W.partitionBy(*keys, "country").orderBy("_day")
    state = state.withColumn("_since", F.max("_since").over(of.rowsBetween(W.unboundedPreceding, 0))).withColumn("_until", F.lead("_day").over(of))
    days = events.groupBy(*keys).agg(F.array_sort(F.collect_set("_day")).alias("_days"))
    s, g = state.filter("_n > 0").alias("s"), days.alias("g")
    later = F.filter("_days", lambda x: (x > F.col("s._day")) & (x <= F.coalesce(F.col("s._until"), x)))
    carried = s.join(g, [F.col(f"s.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]).select(*[f"s.{k}" for k in keys], "s.country", "s._n", "s._since", F.explode(later).alias("_day"))
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    rows = events.select(*keys, "_day", "event_no", "t", "country", "d", F.lit(0).cast("int").alias("_since"))
    rows = rows.unionByName(carried.select(*keys, "_day", F.lit(0).cast("int").alias("event_no"), none("t"), "country", F.col("_n").cast("int").alias("d"), F.col("_since").cast("int").alias("_since")))
    group = [*keys, "_day"]

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, group):
            number, country, change, since = (table.column(c).to_pylist() for c in ("event_no", "country", "d", "_since"))
            begins, at, text = set(map(int, starts)), [], []
            for i in range(table.num_rows):
                if i in begins:
                    active: dict[str, tuple[int, int]] = {}  # -count and first event, so that the least comes first
                c = country[i]
                if not number[i]:
                    active[c] = (-change[i], since[i])
                    continue
                if c is not None:
                    n, first = active.pop(c, (0, number[i]))
                    if n - change[i] < 0:
                        active[c] = (n - change[i], first)
                at.append(i)
                text.append(", ".join(f"{k} ({-n})" for k, (n, _) in nsmallest(top, active.items(), key=lambda x: x[1])) or "(none)")
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks().take(take) for c in (*keys, "event_no", "t")], pa.array(text, pa.string())], [*keys, "event_no", "t", "countries"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "event_no", "t")) + ", countries string"
    return laid_out(rows, group, "event_no", "_since").mapInArrow(lists, schema)


def wait_text(micros: Column) -> Column:
    """A signed span as text, e.g. ``1 day, 2:03:04`` or ``0:05:00 ago``; microseconds only if there are any."""
    size = F.abs(micros)
    days, rest = F.floor(size / F.lit(86_400_000_000)).cast("bigint"), F.pmod(size, F.lit(86_400_000_000))
    h, m, s, us = F.floor(rest / F.lit(3_600_000_000)).cast("bigint"), F.pmod(F.floor(rest / F.lit(60_000_000)).cast("bigint"), F.lit(60)), F.pmod(F.floor(rest / F.lit(1_000_000)).cast("bigint"), F.lit(60)), F.pmod(rest, F.lit(1_000_000))
    day = F.when(days == 1, F.lit("1 day, ")).when(days > 1, F.concat(days.cast("string"), F.lit(" days, "))).otherwise("")
    clock = F.concat(h.cast("string"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"), F.lit(":"), F.lpad(s.cast("string"), 2, "0"))
    fine = F.when(us > 0, F.concat(F.lit("."), F.lpad(us.cast("string"), 6, "0"))).otherwise("")
    return F.concat(day, clock, fine, F.when(micros < 0, F.lit(" ago")).otherwise(""))


def local_text(at: Column, zone: str) -> Column:
    """ISO text of the local time in a zone, with its offset, to the second."""
    local = F.from_utc_timestamp(at, zone)
    minutes = ((F.unix_seconds(local) - F.unix_seconds(at)) / 60).cast("int")
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.pmod(F.abs(minutes), F.lit(60)).cast("string"), 2, "0"))
    return F.concat(F.date_format(local, FULL), offset)


def display_rows(raw: DataFrame, uplink_end: Column, zone: str = "UTC", country: str | None = None) -> DataFrame:
    """Observation rows for a table: readable times in UTC and ``zone``, their raw text where they can't be read, and the wait."""
    start, end = (iso_instant(F.col(c)) for c in ("start", "end"))
    text = lambda t, c: F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col(c), F.lit("?"))
    local = lambda t: F.coalesce(local_text(t, zone), F.lit("?"))
    wait = F.when(start.isNotNull() & uplink_end.isNotNull(), wait_text(F.unix_micros(start) - F.unix_micros(uplink_end))).otherwise("N/A")
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    return raw.select(
        known("id").alias("id"), known("ground_station").alias("ground_station"), (known(country) if country else F.lit("?")).alias("country"),
        text(start, "start").alias("start_utc"), text(end, "end").alias("end_utc"), local(start).alias("start_local"), local(end).alias("end_local"), wait.alias("wait"),
    )


def info_text(country: Column | None = None) -> Column:
    """One line about an observation; needs id, ground_station, station_lat, station_lng, observer."""
    q = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    place = F.concat(F.lit("GS "), q("ground_station"), F.lit(" @ "), q("station_lat"), F.lit(", "), q("station_lng"), F.lit(" (in "), F.coalesce(F.lit(None).cast("string") if country is None else country, F.lit("None")), F.lit(")"))
    return F.concat_ws(" | ", F.concat(F.lit("Observation "), q("id")), place, F.concat(F.lit("Observer: "), q("observer")))


def nearest_place(points: DataFrame, places: DataFrame, lat: str, lng: str, code: str = "code", cell_degrees: float = 5.0, most_places: int = 200_000) -> DataFrame:
    """Adds ``code`` of the nearest place (place_lat, place_lng, code) by great-circle distance, ties by code.

    Distinct coordinates are looked up once. Places are gathered by grid cell: a point meets the places of its own
    and the neighbouring cells, and points that could have a nearer place further away, or none at all, are then
    held against all places, a broadcast gazetteer of at most ``most_places``.
    """
    asked = points.select(F.col(lat).alias("_lat"), F.col(lng).alias("_lng")).filter("_lat IS NOT NULL AND _lng IS NOT NULL").distinct()
    rad = F.radians
    a, b = F.col("_lat"), F.col("place_lat")
    h = F.pow(F.sin(rad(b - a) / 2), 2) + F.cos(rad(a)) * F.cos(rad(b)) * F.pow(F.sin(rad(F.col("place_lng") - F.col("_lng")) / 2), 2)
    far = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))
    size, turn = F.lit(cell_degrees), int(round(360 / cell_degrees))
    cell = lambda x: F.floor(x / size).cast("int")
    near = asked.select("_lat", "_lng", F.explode(F.expr("sequence(-1, 1)")).alias("_dy"), F.expr("sequence(-1, 1)").alias("_xs")).select("_lat", "_lng", (cell(F.col("_lat")) + F.col("_dy")).alias("_y"), F.explode("_xs").alias("_dx"))
    near = near.select("_lat", "_lng", "_y", F.pmod(cell(F.col("_lng")) + F.col("_dx"), F.lit(turn)).alias("_x"))
    known = places.select(F.col("place_lat").cast("double"), F.col("place_lng").cast("double"), F.col(code).alias("_code"))
    gridded = known.withColumn("_y", cell(F.col("place_lat"))).withColumn("_x", F.pmod(cell(F.col("place_lng")), F.lit(turn)))
    best = lambda df: df.withColumn("_far", far).groupBy("_lat", "_lng").agg(F.min(F.struct("_far", "_code")).alias("_best"))
    first = best(near.join(gridded, ["_y", "_x"]))
    # beyond the nine cells a place is at least a cell's height away, or a cell's width, narrower towards the poles
    sure = F.col("_best._far") <= size * F.cos(rad(F.least(F.lit(90.0), F.abs("_lat") + cell_degrees))) * 0.9
    settled = first.filter(sure)
    rest = asked.join(settled.select("_lat", "_lng"), ["_lat", "_lng"], "left_anti")
    if known.limit(most_places + 1).count() > most_places:
        raise ValueError(f"a gazetteer of more than {most_places} places")
    exhaustive = best(rest.crossJoin(F.broadcast(known)))
    found = settled.unionByName(exhaustive).select("_lat", "_lng", F.col("_best._code").alias(code), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_salt"))
    salted = points.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(16)).cast("int"))  # one place may have most points
    joined = salted.join(found, (salted[lat] == found["_lat"]) & (salted[lng] == found["_lng"]) & (salted["_salt"] == found["_salt"]), "left")
    return joined.drop(salted["_salt"]).drop("_lat", "_lng", "_salt")


def with_country(points: DataFrame, places: DataFrame, names: DataFrame, lat: str, lng: str) -> DataFrame:
    """Adds ``country``, the name of the nearest place's country; null without coordinates or a name."""
    found = nearest_place(points, places, lat, lng)
    return found.join(names.select("code", "country"), "code", "left").drop("code")
