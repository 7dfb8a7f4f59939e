"""Every query of the core over tables without rows."""

from pathlib import Path

from groundlake.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def emptied(spark, folder):
    for p in Path(FOLDER).glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).write.parquet(f"{folder}/{p.name}")
    return str(folder)


def test_queries_over_empty_tables(spark, tmp_path):
    folder = emptied(spark, tmp_path)
    for name, query in catalog.queries().items():
        assert query(spark, folder).count() == (1 if name in ("coverage_totals", "coverage_report") else 0), name
