"""Queries of the text problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundlake.llm import encode, mix, spam
from groundlake.plans.tables import table


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode(table(spark, folder, "documents"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix.mix(table(spark, folder, "documents"), table(spark, folder, "source_target")).documents


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix.mix(table(spark, folder, "documents"), table(spark, folder, "source_target")).shares


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.suspects(table(spark, folder, "documents")).filter("spam").select("doc_id")


QUERIES = {f.__name__: f for f in (p7_ids, p8_mix, p8_shares, p9_found)}
ORACLE: dict[str, str] = {}
