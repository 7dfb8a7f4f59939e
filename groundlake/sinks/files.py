"""Writers: tables, coverage, agendas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundlake.functions.commands import readable
from groundlake.operators import coverage
from groundlake.session import written


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table that several results are made of, written once to the shared folder."""
    return written(df, name)


def single_file(df: DataFrame, path: str, form: str, **options: str) -> None:
    """One file of that name: written by one task into a folder beside it, then renamed. For results that fit a task."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path
    target = where(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    beside = where(f"{path}.{uuid.uuid4().hex[:8]}.parts")
    try:
        df.coalesce(1).write.options(**options).format(form).save(beside.toString())
        made = [s.getPath() for s in fs.listStatus(beside) if s.getPath().getName().startswith("part-")]
        fs.delete(target, False)
        if not made:
            fs.create(target, True).close()
        elif not fs.rename(made[0], target):
            raise OSError(f"cannot write {path}")
    finally:
        fs.delete(beside, True)


def text_file(lines: DataFrame, path: str, order: list[str], head: list[str] = []) -> int:  # noqa: B006
    """Writes ``line`` in order below the lines of ``head``; returns the number of lines."""
    spark = lines.sparkSession
    out = kept(lines.select(F.lit(1).alias("_part"), *order, "line"), "lines")
    if head:
        top = spark.createDataFrame(list(enumerate(head)), "_at int, line string").select(F.lit(0).alias("_part"), "_at", "line")
        out = out.withColumn("_at", F.lit(0)).unionByName(top, allowMissingColumns=True)
    single_file(out.orderBy("_part", *(["_at"] if head else []), *order).select(F.col("line").alias("value")), path, "text")
    return out.count()


def decoded_csv(decoded: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; a folder of files unless ``single``, which suits small results only."""
    if single:
        single_file(decoded, path, "csv", header="true")
    else:
        decoded.write.mode("overwrite").option("header", "true").csv(path)


def decoded_parquet(decoded: DataFrame, path: str, file_rows: int = 2_000_000) -> None:
    """The native form, split by day of receipt; a day has as many files as its rows need, over which rows are spread evenly."""
    rows = decoded.withColumn("day", F.to_date("received_timestamp"))
    most = rows.groupBy("day").count().agg(F.max("count")).head()[0] or 1
    spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "day"]), F.lit(-(-most // file_rows)))
    rows.repartition("day", spread).write.mode("overwrite").partitionBy("day").parquet(path)


def coverage_tsv(windows: DataFrame, path: str, least_stations: int = 1, sort: str = "time") -> bool:
    """Tab-separated windows in order; without any, nothing is written and False comes back."""
    out = coverage.filtered(windows, least_stations, sort)
    if out.isEmpty():
        return False
    single_file(coverage.shown(out), path, "csv", sep="\t", header="true")
    return True


def agenda_text(agenda: DataFrame, path: str, order: list[str], with_times: bool = False) -> None:
    """The lines of an agenda in order, one file; ``with_times`` puts readable times in front of commands."""
    text_file(agenda.withColumn("line", readable(F.col("line"))) if with_times else agenda, path, order)


def summary_comment(sheet: DataFrame) -> list[str]:
    """A sheet as remark lines: without columns of one letter, commands without prefix and suffix. Sheets are small."""
    names = [c for c in sheet.columns if len(c.strip()) > 1 and c != "row_no"]
    short = F.regexp_replace(F.regexp_replace("Telecommand", r"^CTS1\+", ""), "!$", "")
    rows = [[str(v or "") for v in r] for r in sheet.orderBy("row_no").select(*[short.alias(c) if c == "Telecommand" else F.col(f"`{c}`") for c in names]).collect()]
    width = [max(len(x) for x in column) for column in zip(names, *rows, strict=True)]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    text = lambda r: "|" + "|".join(f" {v:<{w}} " for v, w in zip(r, width, strict=True)) + "|"
    return [f"# {x}" for x in (rule, text(names), rule, *map(text, rows), rule)]
