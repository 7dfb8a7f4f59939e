"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundlake.plans import agenda_queries, coverage_queries, decoding, problems

_MODULES = (decoding, coverage_queries, agenda_queries, problems)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return decoding.packet_type_summary(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
