"""Command agendas as ordered rows: from pass schedules, sheets and files.

An agenda is a DataFrame with sort keys and ``line``; a sink orders by the keys and writes the lines. Rows that are
expanded (ticks, repeats, chunks) come from generators inside the executors, never from a driver loop.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundlake.functions.commands import FORBIDDEN, pass_command, priority_parts, sheet_command, tagged
from groundlake.functions.ordered import running_sums
from groundlake.session import written

STEP_MS = 1000  # fixed value: tssent distance of successive commands


@dataclass(frozen=True)
class PassPlan:
    """Parameters of a pass agenda; times in epoch milliseconds."""

    uplink_start_ms: int
    loop_commands: list[str]
    priority_commands: list[str] = field(default_factory=list)
    uplink_minutes: float = 15.0
    block_ms: int = 20_000
    command_ms: int = 2_000
    priority_every: int = 50
    satellite: str = ""
    mission: str = ""  # stands in the agenda's title
    next_hours: float = 24.0

    @property
    def uplink_end_ms(self) -> int:
        return self.uplink_start_ms + round(self.uplink_minutes * 60_000)


def upcoming(passes: DataFrame, keys: list[str], plan: PassPlan) -> DataFrame:
    """Passes (keys, id, start_ms, end_ms, ...) that begin after the uplink; reversed ones are left out."""
    return passes.filter((F.col("start_ms") > plan.uplink_end_ms) & (F.col("end_ms") >= F.col("start_ms")))


def pass_changes(passes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, t_ms, start_ms, kind, d, ...): a row for each AOS and LOS with the change ``d`` of passes in sight.

    An id is in sight or not: an AOS of one in sight adds nothing, and its next LOS ends all passes of that id. Ties by
    time keep the order of passes by start and id, an AOS before its own LOS.
    """
    more = [c for c in passes.columns if c not in (*keys, "id", "start_ms", "end_ms")]
    ends = F.explode(F.array(F.struct(F.col("start_ms").alias("t_ms"), F.lit(0).alias("_k"), F.lit("AOS").alias("kind")), F.struct(F.col("end_ms").alias("t_ms"), F.lit(1).alias("_k"), F.lit("LOS").alias("kind"))))
    both = passes.select(*keys, "id", "start_ms", *more, ends.alias("_e")).select(*keys, "id", "start_ms", *more, "_e.*")
    last = F.lag("kind").over(W.partitionBy(*keys, "id").orderBy("t_ms", "start_ms", "_k"))
    fresh = F.coalesce(last, F.lit("LOS")) != F.col("kind")
    return both.withColumn("d", F.when(fresh, F.when(F.col("kind") == "AOS", 1).otherwise(-1)).otherwise(0))


def sights(passes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, start_ms, end_ms): the spans in which each id is in sight."""
    changes = pass_changes(passes, keys).filter("d <> 0")
    until = F.lead("t_ms").over(W.partitionBy(*keys, "id").orderBy("t_ms", "start_ms", "_k"))
    return changes.select(*keys, "id", "kind", F.col("t_ms").alias("start_ms"), until.alias("end_ms")).filter("kind = 'AOS'").drop("kind")


def active_ticks(passes: DataFrame, keys: list[str], block_ms: int) -> DataFrame:
    """(keys, tick, t_ms): the grid from the first start in steps of ``block_ms``, where a pass is active.

    A pass is active from its start up to, without, its end. Each pass yields the ticks inside itself, so the work
    follows the covered time and there is no join of ticks with passes.
    """
    if block_ms <= 0:
        raise ValueError("the block interval must be positive")
    first = passes.groupBy(*keys).agg(F.min("start_ms").alias("_first"))
    p, f = passes.alias("p"), first.alias("f")
    rows = p.join(f, [F.col(f"p.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]).select("p.*", "f._first")
    low = F.ceil((F.col("start_ms") - F.col("_first")) / F.lit(block_ms)).cast("bigint")
    high = F.ceil((F.col("end_ms") - F.col("_first")) / F.lit(block_ms)).cast("bigint") - 1
    ticks = rows.filter(high >= low).select(*keys, "_first", F.explode(F.sequence(low, high)).alias("tick")).distinct()
    return ticks.select(*keys, "tick", (F.col("_first") + F.col("tick") * block_ms).alias("t_ms"))


def _listed(commands: list[str]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("command")) for i, c in enumerate(commands)])


def loop_commands(ticks: DataFrame, keys: list[str], plan: PassPlan) -> DataFrame:
    """(keys, n, t_ms, tick, line): every loop command at every tick, numbered; tssent goes on after the priority ones."""
    if not plan.loop_commands:
        raise ValueError("no loop commands")
    rows = ticks.select(*keys, "tick", "t_ms", F.explode(_listed(plan.loop_commands)).alias("_c")).select(*keys, "tick", "t_ms", "_c.*")
    # a tick has as many numbers as there are commands, so the count of ticks before it gives its first number
    day = F.floor(F.col("t_ms") / F.lit(86_400_000)).cast("bigint")
    rows = running_sums(rows, keys, day, ["tick", "position"], {"_n": F.lit(1)})
    n = (F.col("_n") - 1).cast("bigint")
    sent = F.lit(plan.uplink_start_ms) + (n + len(plan.priority_commands)) * STEP_MS
    executed = F.col("t_ms") + F.col("position") * plan.command_ms
    return rows.select(*keys, n.alias("n"), "t_ms", "tick", pass_command(F.col("command"), sent, executed).alias("line"))


def priority_lines(plan: PassPlan) -> list[tuple[str, int]]:
    """Each priority command with its fixed tssent; equal texts share the last one."""
    sent = {c: plan.uplink_start_ms + i * STEP_MS for i, c in enumerate(plan.priority_commands)}
    return [(c, sent[c]) for c in plan.priority_commands]


def injections(commands: DataFrame, keys: list[str], plan: PassPlan) -> DataFrame:
    """(keys, n, position, line): priority commands before every ``priority_every``-th loop command; position -1 is the remark."""
    if plan.priority_every <= 0:
        raise ValueError("the priority interval must be positive")
    listed = priority_lines(plan)
    if not listed:
        return commands.filter(F.lit(False)).select(*keys, "n", F.lit(0).alias("position"), "line")
    array = _numbered(listed)
    at = commands.filter((F.col("n") > 0) & (F.col("n") % plan.priority_every == 0)).select(*keys, "n")
    each = at.select(*keys, "n", F.explode(array).alias("_c")).select(*keys, "n", "_c.*")
    core, executed = priority_parts(F.col("command"))
    lines = each.select(*keys, "n", "position", pass_command(core, F.col("sent"), executed).alias("line"))
    remark = at.select(*keys, "n", F.lit(-1).alias("position"), F.concat(F.lit("# PRIORITY ["), F.col("n").cast("string"), F.lit("]")).alias("line"))
    return remark.unionByName(lines)


def pass_events(passes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t_ms, ordinal, line): AOS and LOS remarks with the number of stations in sight after each.

    ``passes`` may have ``info``, the text about an observation; without it the id stands there.
    """
    rows = passes if "info" in passes.columns else passes.withColumn("info", F.concat(F.lit("Observation "), F.col("id").cast("string")))
    day = F.floor(F.col("t_ms") / F.lit(86_400_000)).cast("bigint")
    both = running_sums(pass_changes(rows, keys), keys, day, ["t_ms", "start_ms", "id", "_k", F.desc(F.abs("d"))], {"ordinal": F.lit(1), "in_sight": F.col("d")})
    at = F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd HH:mm:ss 'UTC'")
    line = F.concat_ws(" | ", F.concat(F.lit("# "), F.col("kind")), at, F.col("info"), F.concat(F.col("in_sight").cast("string"), F.lit(" station(s) in sight")))
    return both.select(*keys, "t_ms", "ordinal", line.alias("line"))


_UTC = "yyyy-MM-dd HH:mm:ss 'UTC'"


def pass_header(passes: DataFrame, keys: list[str], plan: PassPlan, generated: str) -> DataFrame:
    """(keys, position, line): remarks on top of each group's agenda; ``generated`` is given so that results can be repeated."""
    at = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S UTC")  # noqa: E731, UP017
    #: fixed values: the remarks' texts
    before = [
        f"# {plan.mission} Command Agenda", f"# Satellite NORAD ID: {plan.satellite}",
        f"# Uplink window: {at(plan.uplink_start_ms)} -> {at(plan.uplink_end_ms)} ({plan.uplink_minutes:.1f} min)",
        f"# Observation fetch window end: {plan.next_hours} hrs after uplink", f"# Generated at: {generated}",
    ]
    after = [
        f"# Time between loop command blocks: {plan.block_ms / 1000:.1f} s", f"# Time between commands in a loop block: {plan.command_ms / 1000:.1f} s",
        f"# Priority command injection interval: every {plan.priority_every} loop commands",
        f"# Loop commands ({len(plan.loop_commands)}):", *[f"#   {c}" for c in plan.loop_commands],
        f"# Priority commands ({len(plan.priority_commands)}):", *[f"#   {c}" for c in plan.priority_commands], "",
    ]
    counts = passes.groupBy(*keys).agg(F.count("*").alias("_n"))
    lines = F.array(*[F.lit(x) for x in before], F.concat(F.lit("# Valid observations: "), F.col("_n").cast("string")), *[F.lit(x) for x in after])
    return counts.select(*keys, F.posexplode(lines).alias("position", "line"))


def _numbered(commands: list[str]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("command"), F.lit(s).cast("bigint").alias("sent")) for i, (c, s) in enumerate(commands)])


def pass_agenda(passes: DataFrame, keys: list[str], plan: PassPlan, generated: str = "") -> DataFrame:
    """(keys, phase, a, b, c, line): the whole agenda of each group; order by the keys, then phase, a, b, c.

    Phase 0 holds the remarks on top, 1 the priority commands below their heading, 2 the timeline's heading, 3 remarks
    and commands by time: a remark comes with the first tick at or after its time (whether a pass is active then or
    not) and so before any command that is later. A group without a pass after the uplink has no agenda.
    """
    first = written(upcoming(passes, keys, plan), "passes")  # each is read several times below
    commands = written(loop_commands(active_ticks(sights(first, keys), keys, plan.block_ms), keys, plan), "commands")
    long = lambda c: F.lit(c).cast("bigint") if isinstance(c, int) else c.cast("bigint")
    row = lambda df, phase, a, b, c, line: df.select(*keys, F.lit(phase).alias("phase"), long(a).alias("a"), long(b).alias("b"), (F.lit(c) if isinstance(c, int) else c.cast("int")).alias("c"), line.alias("line"))
    parts = [row(pass_header(first, keys, plan, generated), 0, F.col("position"), 0, 0, F.col("line"))]
    groups = first.groupBy(*keys).agg(F.min("start_ms").alias("_first"))
    listed = priority_lines(plan)
    if listed:
        each = groups.select(*keys, F.explode(_numbered(listed)).alias("_c")).select(*keys, "_c.*")
        core, executed = priority_parts(F.col("command"))
        parts.append(row(each, 1, F.col("position"), 0, 0, pass_command(core, F.col("sent"), executed)))
        frame = F.explode(F.array(F.struct(F.lit(-1).alias("p"), F.lit("# PRIORITY COMMANDS").alias("line")), F.struct(F.lit(len(listed)).alias("p"), F.lit("").alias("line"))))
        parts.append(row(groups.select(*keys, frame.alias("_f")).select(*keys, "_f.*"), 1, F.col("p"), 0, 0, F.col("line")))
    started = F.array(F.concat(F.lit("# Timeline start: "), F.date_format(F.timestamp_millis("_first"), _UTC)), F.lit(""))
    parts.append(row(groups.select(*keys, F.posexplode(started).alias("p", "line")), 2, F.col("p"), 0, 0, F.col("line")))
    parts.append(row(pass_events(first, keys), 3, F.col("t_ms"), F.col("ordinal") - F.lit(2**40), 0, F.col("line")))
    times = commands.select(*keys, "n", "t_ms")
    e, t = injections(commands, keys, plan).alias("e"), times.alias("t")
    placed = e.join(t, [*[F.col(f"e.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys], F.col("e.n") == F.col("t.n")]).select("e.*", "t.t_ms")
    parts.append(row(placed, 3, F.col("t_ms"), F.col("n") * 2, F.col("position"), F.col("line")))
    parts.append(row(commands, 3, F.col("t_ms"), F.col("n") * 2 + 1, 0, F.col("line")))
    return reduce(DataFrame.unionByName, parts)


def lines_in_order(agenda: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, line): an agenda's lines with their places from 1, without a task for a whole agenda."""
    day = F.when(F.col("phase") == 3, F.floor(F.col("a") / F.lit(86_400_000))).otherwise(F.lit(-(2**40))).cast("bigint")
    out = running_sums(written(agenda.withColumn("_day", day), "agenda"), keys, F.col("_day"), ["phase", "a", "b", "c"], {"line_no": F.lit(1)})
    return out.select(*keys, F.col("line_no").cast("bigint").alias("line_no"), "line")


def forbidden(agenda: DataFrame) -> DataFrame:
    """Lines with a tag behind the end of a command; an agenda must have none."""
    return agenda.filter(F.col("line").contains(FORBIDDEN))


def checked(agenda: DataFrame) -> DataFrame:
    """The agenda, whose evaluation fails on a forbidden line."""
    return agenda.withColumn("line", F.when(F.col("line").contains(FORBIDDEN), F.raise_error(F.concat(F.lit("forbidden text in: "), F.col("line"))).cast("string")).otherwise(F.col("line")))


# -- Sheets ---------------------------------------------------------------------------------------------------------


CLOCK = r"^(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?$"


def clock_time(value: Column, mission_date: Column, mission_start: Column) -> Column:
    """Epoch milliseconds of a time of day on the mission date, a day later if that is before the mission's start.

    ``past`` and 0 are the epoch; null, empty and ``nan`` are null; other text raises. ``mission_start`` in ms.
    """
    text = F.trim(value)
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, CLOCK, k), F.lit("")), F.lit("0")).cast("int")
    h, m, s = part(1), part(2), part(3)
    midnight = F.unix_millis(F.try_to_timestamp(mission_date.cast("string"), F.lit("yyyy-MM-dd")))
    ms = F.when(text.rlike(CLOCK) & (h < 24) & (m < 60) & (s < 60), midnight + ((h * 60 + m) * 60 + s) * 1000)
    placed = F.when(ms < mission_start, ms + 86_400_000).otherwise(ms)
    zero = (F.lower(text) == "past") | F.coalesce(text.try_cast("double") == 0, F.lit(False))
    bad = F.raise_error(F.concat(F.lit("no time of day: "), text)).cast("bigint")
    return F.when(value.isNull() | (text == "") | (F.lower(text) == "nan"), F.lit(None).cast("bigint")).when(zero, F.lit(0).cast("bigint")).when(placed.isNotNull(), placed).otherwise(bad)


def span_us(text: Column) -> Column:
    """Microseconds of ``<number> sec...`` or ``<number> min...``; null for null or empty, others raise."""
    parts = F.split(F.lower(F.trim(text)), r"\s+")
    number, unit = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2))
    factor = F.when(unit.startswith("sec"), 1e6).when(unit.startswith("min"), 6e7)
    bad = F.raise_error(F.concat(F.lit("unknown interval: "), text)).cast("bigint")
    return F.when(text.isNull() | (F.trim(text) == ""), F.lit(None).cast("bigint")).when((F.size(parts) == 2) & number.isNotNull() & factor.isNotNull(), F.round(number * factor).cast("bigint")).otherwise(bad)


def whole_number(text: Column, default: int = 0) -> Column:
    """An integer of text that may hold a decimal number, cut towards zero; empty and ``nan`` give the default."""
    t = F.trim(text)
    return F.when(text.isNull() | (t == "") | (F.lower(t) == "nan"), F.lit(default)).otherwise(t.cast("double").cast("int"))


def repeated(rows: DataFrame, times: str, copy: str = "copy") -> DataFrame:
    """As many copies of each row as its column ``times`` says, none for 0 or less; ``copy`` counts from 1."""
    n = F.col(times)
    return rows.withColumn(copy, F.explode(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))))


def stepped(rows: DataFrame, start: str, end: str, step: str, name: str = "at") -> DataFrame:
    """A row for each of start, start + step, ... up to and with end; none if end is before start; a step of 0 raises."""
    a, z, s = F.col(start), F.col(end), F.col(step)
    number = F.floor((z - a) / F.when(s > 0, s)).cast("bigint")
    wrong = F.raise_error(F.lit("the interval must be positive")).cast("array<bigint>")
    ks = F.when(~(s > 0), wrong).when(z >= a, F.sequence(F.lit(0).cast("bigint"), number)).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("_k", F.explode(ks)).withColumn(name, a + F.col("_k") * s).drop("_k")


def sheet_agenda(sheet: DataFrame, mission_date: str, mission_start_ms: int) -> tuple[DataFrame, DataFrame]:
    """(ordered, scattered) commands of a sheet with ``row_no`` and the sheet's columns.

    ordered: (tssent_ms, row_no, copy, line), to be ordered by these; scattered: (row_no, copy, line).
    """
    date, start = F.lit(mission_date), F.lit(mission_start_ms).cast("bigint")
    c = lambda n: F.col(f"`{n}`")
    fill = lambda n: F.replace(F.coalesce(c(n), F.lit("")), F.lit("{DATE}"), date)
    mode = F.lower(F.trim(c("Mode")))
    rows = sheet.select(
        "row_no", F.when(mode.isin("single", "interval"), mode).otherwise(F.raise_error(F.lit("Mode must be Single or Interval")).cast("string")).alias("mode"), fill("Telecommand").alias("cmd"), fill("resp_fname").alias("resp"),
        clock_time(c("tssent (UTC)"), date, start).alias("sent"), clock_time(c("tsexec Start (UTC)"), date, start).alias("begin"), clock_time(c("tsexec End (UTC)"), date, start).alias("until"),
        c("Interval").alias("interval"), whole_number(c("Repeat")).alias("repeat"), whole_number(c("Random")).alias("random"),
    )
    need = lambda col, what: F.coalesce(col, F.raise_error(F.concat(F.lit(f"missing {what} for "), F.col("cmd"))).cast("bigint"))
    single = rows.filter("mode = 'single'").withColumn("line", sheet_command(F.col("cmd"), need(F.col("sent"), "tssent"), need(F.col("begin"), "tsexec"), F.col("resp")))
    fixed = repeated(single, "repeat").select(F.col("sent").alias("tssent_ms"), "row_no", F.col("copy").cast("bigint").alias("copy"), "line")
    loose = repeated(single, "random").select("row_no", "copy", "line")
    runs = rows.filter("mode = 'interval'").select("row_no", "cmd", "resp", (need(F.col("begin"), "start") * 1000).alias("a"), (need(F.col("until"), "end") * 1000).alias("z"), need(span_us(F.col("interval")), "interval").alias("step"))
    runs = stepped(runs, "a", "z", "step").withColumn("ms", F.floor(F.col("at") / F.lit(1000)).cast("bigint"))
    runs = runs.select(F.col("ms").alias("tssent_ms"), "row_no", F.col("at").alias("copy"), sheet_command(F.col("cmd"), F.col("ms"), F.col("ms"), F.col("resp")).alias("line"))
    return fixed.unionByName(runs), loose


def scattered(ordered: DataFrame, loose: DataFrame, keys: list[str], loose_keys: list[str], seed: int, block: Column) -> DataFrame:
    """(slot, line): the loose rows at uniformly random places among the ordered ones, which keep their order.

    Every row draws a uniform number by hash; the k-th smallest draw of the ordered rows goes to its k-th row, and
    the order of all draws is the interleaving. Ranks come from blocks, ``block`` for the order of ``keys`` (it must
    not fall along it) and equal parts of the draws, as many as the rows need, so no task orders the whole agenda.
    """
    bits = 52
    part = F.floor(F.col("_u") / F.lit(2**bits) * max(1, ordered.count() // 4096)).cast("bigint")
    draw = lambda tag, *c: F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), *c), F.lit(2**bits))
    lines = running_sums(ordered, [], block, keys, {"_k": F.lit(1)})
    draws = running_sums(lines.select(draw("ordered", F.col("_k")).alias("_u"), F.col("_k").alias("_of")), [], part, ["_u", "_of"], {"_k": F.lit(1)})
    placed = lines.join(draws.select("_u", "_k"), "_k").select("_u", F.col("_k").alias("_tie"), "line")
    free = loose.select(draw("loose", *[F.col(k) for k in loose_keys]).alias("_u"), F.lit(0).cast("bigint").alias("_tie"), "line")
    out = running_sums(placed.unionByName(free), [], part, ["_u", "_tie", "line"], {"slot": F.lit(1)})
    return out.select("slot", "line")


# -- Files ----------------------------------------------------------------------------------------------------------


def chunks(files: DataFrame, keys: list[str], content: str, size: int = 96) -> DataFrame:
    """(keys, chunk, offset, data): pieces of ``size`` bytes, the last one shorter; none of an empty file."""
    if size <= 0:
        raise ValueError("the chunk size must be positive")
    n = F.length(content)
    count = F.ceil(n / F.lit(size)).cast("int")
    ks = F.when(n > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    rows = files.select(*keys, F.col(content).alias("_data"), F.explode(ks).alias("chunk"))
    offset = F.col("chunk") * size
    return rows.select(*keys, "chunk", offset.alias("offset"), F.substring("_data", offset + 1, F.lit(size)).alias("data"))


def chunk_command(mode: str, target: Column) -> Column:
    """The command that carries a chunk (columns data, offset)."""
    digits = F.lower(F.hex("data"))
    if mode == "bulk_uplink_hex":
        return F.concat(F.lit("CTS1+bulkup16("), digits, F.lit(")"))
    if mode == "bulk_uplink_b64":
        return F.concat(F.lit("CTS1+bulkup64("), F.regexp_replace(F.base64("data"), "[\r\n]", ""), F.lit(")"))
    if mode == "write_file_hex":
        return F.concat(F.lit("CTS1+fs_write_file_hex("), target, F.lit(","), F.col("offset").cast("string"), F.lit(","), digits, F.lit(")"))
    raise ValueError("mode: bulk_uplink_b64, bulk_uplink_hex or write_file_hex")


def file_uplink(files: DataFrame, keys: list[str], content: str, target: str, *, mode: str = "bulk_uplink_b64", size: int = 96, hash_count: int = 30, tssent_start_ms: int | None = None, tssent_step_ms: int = 1000, tsexec_start_ms: int | None = None, tsexec_step_ms: int = 30_000, name: str | None = None, given: dict[str, object] | None = None) -> DataFrame:
    """(keys, phase, step, line) of the commands that write each file, in order of phase and step, then its checksum.

    Phases: 0 close, 1 setting (executed at once), 2 open, 3 data, 4 close, 5 checksum requests, 6 remark. Times
    advance by command; the setting takes no execution time. A command's number follows from the chunk count, so
    nothing is ordered to number it. Phase 6 holds the file's checksum and, if ``name`` gives the column of file names,
    the arguments; ``given`` replaces the start times in these by the texts they were given as.
    """
    bulk = mode != "write_file_hex"
    to = F.col(target)
    base = files.select(*keys, *([] if target in keys else [to]), F.length(content).alias("_n"), F.sha2(F.col(content), 256).alias("_sha"), *([F.col(name).alias("_name")] if name else []))
    n_chunks = F.ceil(F.col("_n") / F.lit(size)).cast("bigint")
    fixed = lambda phase, step, text, index: F.struct(F.lit(phase).alias("phase"), step.cast("bigint").alias("step"), text.alias("command"), index.cast("bigint").alias("index"))
    zero = F.lit(0)
    lead = [fixed(0, zero, F.lit("CTS1+comms_bulk_uplink_close_file()"), zero)] if bulk else []
    lead.append(fixed(1, zero, F.lit("CTS1+config_set_int_var(TCMD_require_unique_tssent,1)"), F.lit(1 if bulk else 0)))
    first = 3 if bulk else 1
    if bulk:
        lead.append(fixed(2, zero, F.concat(F.lit("CTS1+comms_bulk_uplink_open_file("), to, F.lit(",truncate)")), F.lit(2)))
        lead.append(fixed(4, zero, F.lit("CTS1+comms_bulk_uplink_close_file()"), n_chunks + first))
    after = n_chunks + first + (1 if bulk else 0)
    if hash_count > 0:
        checks = F.transform(F.sequence(F.lit(0), F.lit(hash_count - 1)), lambda i: fixed(5, i, F.concat(F.lit("CTS1+fs_read_file_sha256_hash_json("), to, F.lit(",0,0)")), after + i))
        frame = F.concat(F.array(*lead), checks)
    else:
        frame = F.array(*lead)
    framed = base.select(*keys, F.explode(frame).alias("_c")).select(*keys, "_c.*")
    extra = [] if target in keys else [target]
    data = chunks(files, [*keys, *extra], content, size)
    data = data.select(*keys, F.lit(3).alias("phase"), F.col("chunk").cast("bigint").alias("step"), chunk_command(mode, to).alias("command"), (F.col("chunk") + first).cast("bigint").alias("index"))
    rows = framed.unionByName(data)
    sent = F.lit(None).cast("bigint") if tssent_start_ms is None else F.lit(tssent_start_ms) + F.col("index") * tssent_step_ms
    # the setting has no execution time, so commands behind it are one step earlier
    turn = F.col("index") - F.when(F.col("index") > (1 if bulk else 0), 1).otherwise(0)
    executed = F.lit(None).cast("bigint") if not tsexec_start_ms else F.when(F.col("phase") != 1, F.lit(tsexec_start_ms) + turn * tsexec_step_ms)
    rows = rows.select(*keys, "phase", "step", tagged(F.col("command"), sent, executed).alias("line"))
    remark = F.concat(F.lit("# SHA256 of input file: "), F.col("_sha"), F.lit(" ("), F.format_number("_n", 0), F.lit(" bytes)"))
    remarks = [remark]
    if name:
        said = {"tssent_start_val": tssent_start_ms, "tsexec_start_val": tsexec_start_ms} | (given or {})
        arguments = {"input_file.name": F.col("_name"), "satellite_file": to, "chunk_size": size, "tssent_start_val": said["tssent_start_val"], "tssent_interval_ms": tssent_step_ms, "tsexec_start_val": said["tsexec_start_val"], "tsexec_interval_ms": tsexec_step_ms, "mode": mode}
        remarks += [F.lit("# Generated with arguments:"), *[F.concat(F.lit(f"#   {k}="), v if isinstance(v, Column) else F.lit(str(v))) for k, v in arguments.items()]]
    return rows.unionByName(base.select(*keys, F.lit(6).alias("phase"), F.posexplode(F.array(*remarks)).alias("step", "line")).withColumn("step", F.col("step").cast("bigint")))


def instant_argument(value: int | str | None) -> int | None:
    """Epoch milliseconds of an argument: a number counts epoch seconds, a text must be ISO 8601 with a zone."""
    if value is None or isinstance(value, int):
        return None if value is None else value * 1000
    at = datetime.fromisoformat(value)
    if at.tzinfo is None:
        raise ValueError(f"give a zone in {value!r}")
    return int(at.timestamp() * 1000)


__all__ = ["PassPlan", "active_ticks", "checked", "chunks", "clock_time", "file_uplink", "forbidden", "injections", "instant_argument", "lines_in_order", "loop_commands", "pass_agenda", "pass_changes", "pass_events", "pass_header", "repeated", "scattered", "sheet_agenda", "sights", "span_us", "stepped", "upcoming", "whole_number"]
