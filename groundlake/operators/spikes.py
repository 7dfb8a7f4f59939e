"""Implausible readings, judged by each source's own course (problem 6).

Per source and field, readings in order of event time run through a Kalman filter with a level and a slope
(integrated white noise acceleration, irregular time steps), once forward and once backward. The acceleration is
that of orbit swings, in seconds, but for a slow source no more than its median interval can tell. A reading whose
standardised innovation exceeds the threshold, or that is further off than a spike from a course that is sure, is
withheld from the update; when more than ``longest`` successive
readings are withheld, the change is lasting and the filter restarts on them. Both predictions of a reading
together are the course its neighbours show. A withheld reading is a spike if it lies more than ``spike`` times the
source's usual scatter off that course, both predictions agree on it, and at most ``longest`` spikes follow each
other. Vanishing innovation variance (no change over ``stuck`` readings) marks stuck values; readings outside the
limits are implausible by themselves. Limit breaches and stuck values never update the filter.

Scale: readings get exact ranks from counts an hour (a prefix sum over hours, a row number inside one), and are
laid out in blocks of ``block`` ranks with ``halo`` more on either side, so a hot source is many tasks; a run of
``stuck`` equal readings shorter than the halo is judged in full. The usual scatter is one robust number a source
and field over all its readings.

Defined results: null readings and events without a usable time are left out; a null source is a source; equal
times are ordered by id; repeated rows are judged as readings of their own; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundlake.functions.batches import laid_out, whole_groups
from groundlake.session import written


@dataclass(frozen=True)
class Judgement:
    innovation: float = 5.0  # threshold of standardised innovations
    spike: float = 8.0  # times the usual scatter
    longest: int = 3
    stuck: int = 8
    #: spectral density of the acceleration, in scatter^2 / s^3
    drive: float = 4e-8
    most_drive: float = 0.5  # the same in scatter^2 / (median interval)^3, which bounds it for slow sources
    agree: float = 5.0  # times the predictions' own uncertainty
    unsure: float = 2.5  # a course less sure than so many scatters proves nothing
    block: int = 4096
    halo: int = 128


def predictions(t: list[float], y: list[float], use: list[bool], rule: Judgement) -> tuple[list[float], list[float], list[bool]]:
    """One-step predictions of the level, their variances, and the withheld readings; y in units of the scatter."""
    n, q, thr2, bar, sure = len(t), rule.drive, rule.innovation**2, rule.spike**2, rule.unsure**2
    mean, var, held = [0.0] * n, [float("inf")] * n, [False] * n
    level = slope = a = b = c = 0.0  # state and its covariance [[a, b], [b, c]]
    last, begun = 0.0, False
    run: list[int] = []
    for i in range(n):
        if begun:
            d = t[i] - last
            if d > 0:
                level += slope * d
                a, b, c = a + 2 * d * b + d * d * c + q * d * d * d / 3, b + d * c + q * d * d / 2, c + q * d
            last = t[i]
            mean[i], var[i] = level, a
        if not use[i]:
            continue
        if not begun:
            level, slope, a, b, c, last, begun = y[i], 0.0, 1.0, 0.0, 1e-3, t[i], True
            continue
        e, s = y[i] - level, a + 1.0
        if e * e > thr2 * s or (e * e > bar and a <= sure):
            held[i] = True
            run.append(i)
            if len(run) > rule.longest:
                for k in run:
                    held[k] = False
                level, slope, a, b, c = sorted(y[k] for k in run)[len(run) // 2], 0.0, 1.0, 0.0, 1e-3
                run = []
            continue
        run = []
        g, h = a / s, b / s
        level += g * e
        slope += h * e
        a, b, c = (1 - g) * a, (1 - g) * b, c - h * b
    return mean, var, held


def equal_runs(y: np.ndarray, stuck: int) -> np.ndarray:
    """True in runs of at least ``stuck`` equal values: the variance of their changes has vanished."""
    n = len(y)
    if not n:
        return np.zeros(0, bool)
    start = np.flatnonzero(np.append(True, y[1:] != y[:-1]))
    length = np.diff(np.append(start, n))
    return np.repeat(length >= stuck, length)


def judge(t: np.ndarray, y: np.ndarray, scatter: float, low: float, high: float, rule: Judgement = Judgement(), interval: float | None = None) -> np.ndarray:
    """True for the implausible readings of one ordered series; ``t`` in seconds, ``interval`` the source's median one."""
    outside = (y < low) | (y > high)
    still = equal_runs(y, rule.stuck)
    out = outside | still
    if not np.isfinite(scatter) or scatter <= 0:
        return out
    if interval is None:
        steps = np.diff(t)
        interval = float(np.median(steps[steps > 0])) if (steps > 0).any() else 0.0
    if interval > 0:
        rule = replace(rule, drive=min(rule.drive, rule.most_drive / interval**3))
    times, scaled = (t - t[0]).tolist(), (y / scatter).tolist()
    back, turned = [times[-1] - x for x in reversed(times)], scaled[::-1]
    found = np.zeros(len(y), bool)
    for _ in range(rule.longest):  # at the edge of a gap, a spike hides the next one from one side until it is withheld
        use = (~(out | found)).tolist()
        mf, vf, hf = predictions(times, scaled, use, rule)
        mb, vb, hb = (x[::-1] for x in predictions(back, turned, use[::-1], rule))
        new = [i for i in np.flatnonzero(np.array(hf) | np.array(hb)) if _off_course(scaled[i], mf[i], vf[i], mb[i], vb[i], rule)]
        found[new] = True
        if not new:
            break
    judged = np.flatnonzero(~out)
    flags = found[judged]
    edge = np.flatnonzero(np.append(True, flags[1:] != flags[:-1])) if len(flags) else np.zeros(0, int)
    length = np.diff(np.append(edge, len(flags)))
    found[judged] = flags & np.repeat(length <= rule.longest, length)
    return out | found


def _off_course(y: float, mf: float, vf: float, mb: float, vb: float, rule: Judgement) -> bool:
    """Is a reading off the course that the predictions of both directions show together?"""
    wf, wb = (0.0 if v == float("inf") else 1 / max(v, 1e-9) for v in (vf, vb))
    if not wf + wb:
        return False
    course, sure = (wf * mf + wb * mb) / (wf + wb), (wf + wb) ** -0.5
    agree = not (wf and wb) or abs(mf - mb) <= rule.agree * (vf + vb + 0.25) ** 0.5
    return agree and sure <= rule.unsure and abs(y - course) > rule.spike


def long_readings(usable: DataFrame, source: str, key: str, fields: list[str]) -> DataFrame:
    """(source, field, us, id, value): one row for each reading that is not null.

    ``field`` is a place in ``fields``, and ``source`` a text that is never null: joins on it need no second layout.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(str(i)).alias("field"), F.col(f).cast("double").alias("value")) for i, f in enumerate(fields)]))
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))
    out = usable.select(name.alias("source"), F.col("event_us").alias("us"), F.col(key).alias("id"), pairs.alias("r"))
    return out.select("source", "r.field", "us", "id", "r.value").filter("value IS NOT NULL")


def ranked(readings: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds ``rank`` (from 0, exact, within source and field), ``scatter`` and ``interval``, without a task for a whole source.

    Scatter: 1.4826 times the median absolute deviation of readings from the line between their two neighbours,
    brought to the scale of one reading; over readings within the limits. Interval: the median of the positive
    seconds between neighbours. The neighbours at the edge of an hour come from one summary row an hour. ``source`` and
    ``field`` must not be null; see ``long_readings``. The readings are read twice, so they should be a stored table.
    """
    hour = ["source", "field", "hour"]
    rows = readings.withColumn("hour", F.floor(F.col("us") / F.lit(3_600_000_000)).cast("bigint"))
    w, hours = W.partitionBy(*hour).orderBy("us", "id"), W.partitionBy("source", "field").orderBy("hour")
    whole = F.struct("us", "id", "value")
    counts = rows.groupBy(*hour).agg(F.count("*").alias("_count"), F.min(whole).alias("_first"), F.max(whole).alias("_last"))
    offsets = counts.select(*hour, F.sum("_count").over(hours.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.lag("_last").over(hours).alias("_from"), F.lead("_first").over(hours).alias("_to"))
    rows = rows.select("*", (F.row_number().over(w) - 1).alias("_n"), *[f(c).over(w).alias(f"_{n}_{c}") for n, f in (("lag", F.lag), ("lead", F.lead)) for c in ("us", "value")])
    joined = rows.alias("r").join(offsets.alias("o"), hour)
    beside = [F.coalesce(f"r._{n}_{c}", f"o.{e}.{c}").alias(f"_{n}_{c}") for n, e in (("lag", "_from"), ("lead", "_to")) for c in ("us", "value")]
    joined = joined.select("source", "field", "r.us", "r.id", "r.value", (F.coalesce("o._before", F.lit(0)) + F.col("r._n")).alias("rank"), *beside)
    share = (F.col("us") - F.col("_lag_us")) / F.nullif(F.col("_lead_us") - F.col("_lag_us"), F.lit(0))
    off = F.col("value") - (F.col("_lag_value") * (1 - share) + F.col("_lead_value") * share)
    scale = F.sqrt(1 + share * share + (1 - share) * (1 - share))
    within = F.lit(False)
    for f, (low, high) in limits.items():
        within = within | ((F.col("field") == f) & F.col("value").between(low, high))
    step = F.col("us") - F.col("_lag_us")
    placed = joined.select("source", "field", "us", "id", "value", "rank", F.when(within, F.abs(off / scale)).alias("_off"), F.when(step > 0, step).alias("_step"))
    placed = written(placed, "ranked")
    usual = placed.groupBy("source", "field").agg((1.4826 * F.percentile_approx("_off", 0.5, 10_000)).alias("scatter"), (F.percentile_approx("_step", 0.5, 10_000) / 1e6).alias("interval"))
    out = placed.join(usual, ["source", "field"], "left")
    return out.select("source", "field", "us", "id", "value", "rank", "scatter", "interval")


def implausible(usable: DataFrame, source: str, key: str, limits: dict[str, tuple[float, float]], rule: Judgement = Judgement()) -> DataFrame:
    """(key, field_name) of implausible readings among events with ``event_us``."""
    if rule.halo < rule.stuck or rule.block < rule.halo:
        raise ValueError("stuck <= halo <= block must hold")
    fields = list(limits)
    by_place = {str(i): limits[f] for i, f in enumerate(fields)}
    rows = ranked(written(long_readings(usable, source, key, fields), "readings"), by_place)
    own = F.floor(F.col("rank") / F.lit(rule.block)).cast("bigint")
    first, last = (F.greatest(F.lit(0), F.floor((F.col("rank") + d) / F.lit(rule.block))).cast("bigint") for d in (-rule.halo, rule.halo))
    rows = rows.select("source", "field", F.explode(F.sequence(first, last)).alias("block"), own.alias("_own"), "us", "id", "value", "scatter", "interval")
    group = ["source", "field", "block"]
    laid = laid_out(rows.withColumn("core", F.col("block") == F.col("_own")).drop("_own"), group, "us", "id")
    kind = laid.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, group):
            us, value, core = (t.column(c).to_numpy(zero_copy_only=False) for c in ("us", "value", "core"))
            scatter, interval, field = t.column("scatter").to_numpy(zero_copy_only=False), t.column("interval").to_numpy(zero_copy_only=False), t.column("field")
            hit = np.zeros(t.num_rows, bool)
            for a, z in zip(starts, [*starts[1:], t.num_rows], strict=True):
                low, high = by_place[field[int(a)].as_py()]
                hit[a:z] = judge(us[a:z] / 1e6, value[a:z], float(np.nan_to_num(scatter[a], nan=0.0)), low, high, rule, float(np.nan_to_num(interval[a], nan=0.0)))
            take = pa.array(np.flatnonzero(hit & core))
            names = pa.array([fields[int(x)] for x in field.take(take).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks().take(take), names], ["id", "field_name"])

    return laid.mapInArrow(run, f"id {kind}, field_name string").withColumnRenamed("id", key)
