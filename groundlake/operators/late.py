"""Late and out-of-order events (problem 4): SQL only.

The triangle of event period by arrival revision: each cell is aggregated once, and a window sums the cells of a
period over the revisions, so that every corrected state of the period comes out. Revision 0 holds what had
arrived when the period was first published, revision r what arrived in the r-th step after that; arrivals after
the cut-off are left out.

Defined results: events without a usable time (null, before ``since``, more than ``ahead`` after receipt) or
without a received packet belong to no period; a null entity is an entity of its own; null values count as events
but not in the mean; a packet id that stands in the receipts more than once counts with its earliest receipt; an
event row that stands in the events more than once counts each time; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

MINUTE = 60_000_000
HOUR = 3_600_000_000


@dataclass(frozen=True)
class Lateness:
    """All in microseconds. The cut-off must lie a whole number of steps after the first publication."""

    period: int = HOUR
    first: int = 70 * MINUTE
    cutoff: int = 7 * HOUR
    step: int = 10 * MINUTE
    since: int = 1_577_836_800_000_000
    ahead: int = 10 * MINUTE

    def __post_init__(self) -> None:
        if (self.cutoff - self.first) % self.step:
            raise ValueError("the cut-off must lie on a step")


USABLE_SQL = """
SELECT e.*, e.{time_ms} * 1000 AS event_us, r.received_us
FROM {{events}} e JOIN (
  SELECT packet_id, unix_micros(CAST(min(ts_received) AS timestamp)) AS received_us
  FROM {{receipts}} WHERE ts_received IS NOT NULL GROUP BY packet_id
) r ON e.packet_id = r.packet_id
WHERE e.{time_ms} >= {since_ms} AND e.{time_ms} * 1000 <= r.received_us + {ahead}
"""

REVISIONS_SQL = """
WITH placed AS (
  SELECT entity, value, event_us - pmod(event_us, {period}) AS start_us, received_us FROM {{usable}}
), arrived AS (
  SELECT entity, start_us, value,
         CAST(greatest(0, ceil((received_us - start_us - {first}) / {step})) AS int) AS revision
  FROM placed WHERE received_us <= start_us + {cutoff}
), cells AS (
  SELECT entity, start_us, revision, count(*) AS n_new, sum(value) AS sum_new, count(value) AS values_new
  FROM arrived GROUP BY entity, start_us, revision
)
SELECT entity, start_us, revision, n_new,
       sum(n_new) OVER so_far AS n_events, sum(sum_new) OVER so_far AS value_sum, sum(values_new) OVER so_far AS n_values
FROM cells
WINDOW so_far AS (PARTITION BY entity, start_us ORDER BY revision ROWS UNBOUNDED PRECEDING)
"""


def usable_events(events: DataFrame, receipts: DataFrame, columns: list[str], time_ms: str = "unix_epoch_time_ms", rule: Lateness = Lateness()) -> DataFrame:
    """The given columns of events with a usable time, with ``event_us`` and ``received_us``."""
    narrow = events.select(*dict.fromkeys([*columns, "packet_id", time_ms]))
    sql = USABLE_SQL.format(time_ms=time_ms, since_ms=rule.since // 1000, ahead=rule.ahead)
    out = events.sparkSession.sql(sql, events=narrow, receipts=receipts.select("packet_id", "ts_received"))
    return out.select(*columns, "event_us", "received_us")


def revisions(usable: DataFrame, entity: str, value: str, rule: Lateness = Lateness()) -> DataFrame:
    """(entity, start_us, revision, n_new, n_events, value_sum, n_values): every published state of every period.

    A period that had no event in time starts with its first correction. At most (cutoff - first) / step + 1 rows
    a period, aggregated on the map side, so a hot entity or period costs no more than others.
    """
    sql = REVISIONS_SQL.format(period=rule.period, first=rule.first, cutoff=rule.cutoff, step=rule.step)
    return usable.sparkSession.sql(sql, usable=usable.selectExpr(f"`{entity}` AS entity", f"`{value}` AS value", "event_us", "received_us"))


def corrected(states: DataFrame) -> DataFrame:
    """(entity, start_us) of the periods that were corrected after their first publication."""
    return states.sparkSession.sql("SELECT DISTINCT entity, start_us FROM {states} WHERE revision > 0", states=states)


def final(states: DataFrame) -> DataFrame:
    """The last state of every period."""
    columns = ", ".join(f"last.{c}" for c in states.columns)
    return states.sparkSession.sql(f"SELECT {columns} FROM (SELECT max_by(struct(*), revision) AS last FROM {{states}} GROUP BY entity, start_us)", states=states)
