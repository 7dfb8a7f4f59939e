"""Running sums and maxima over long ordered groups, in two levels.

A plain window over a group is one task, and a hot group may hold a third of all rows. Here the group is cut into
blocks of its leading order column: rows are ordered inside a block, and only one row a block is ordered across the
group. Nulls in keys form a group of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _attach(rows: DataFrame, cells: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    r, c = rows.alias("r"), cells.alias("c")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key]
    return r.join(c, same).select("r.*", *[f"c.{n}" for n in names])


def running_sums(rows: DataFrame, keys: list[str], block: Column, order: list, sums: dict[str, Column]) -> DataFrame:
    """Adds inclusive running sums in ``order``; ``block`` must not fall along it."""
    key = [*keys, "_block"]
    rows = rows.withColumn("_block", block).withColumns({f"_v_{n}": v for n, v in sums.items()})
    cells = rows.groupBy(*key).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    across = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(*key, *[F.coalesce(F.sum(f"_s_{n}").over(across), F.lit(0)).alias(f"_p_{n}") for n in sums])
    inside = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = _attach(rows, cells, key, [f"_p_{n}" for n in sums])
    out = out.withColumns({n: F.col(f"_p_{n}") + F.sum(f"_v_{n}").over(inside) for n in sums})
    return out.drop("_block", *[f"{p}{n}" for n in sums for p in ("_v_", "_p_")])


def maximum_before(rows: DataFrame, keys: list[str], block: Column, order: list, value: str, name: str) -> DataFrame:
    """Adds the largest ``value`` of all rows before each row in ``order``; null for the first."""
    key = [*keys, "_block"]
    rows = rows.withColumn("_block", block)
    cells = rows.groupBy(*key).agg(F.max(value).alias("_m"))
    cells = cells.select(*key, F.max("_m").over(W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_reach"))
    inside = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = _attach(rows, cells, key, ["_reach"])
    return out.withColumn(name, F.greatest("_reach", F.max(value).over(inside))).drop("_block", "_reach")
