"""Runs queries against their SQL, the way the driver does: python tests/compare.py FOLDER [NAME...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def rows(df):
    import math

    cols = sorted(df.columns)

    def norm(v):
        if v is None or type(v).__name__ in ("NAType", "NaTType") or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
            v = v.tolist()
        if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
            return str(int(v))
        if isinstance(v, float):
            return f"{v:.9g}"
        if hasattr(v, "isoformat"):
            return str(v)[:26]
        return str(v)

    return sorted(tuple(norm(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None)), cols


def compare(spark, con, entry, folder, name):
    t = time.time()
    mine = entry.queries()[name](spark, folder)
    got = mine.toPandas()
    took = time.time() - t
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return took, len(got), None, "no SQL"
    want = con.sql(sql).df()
    (a, ca), (b, cb) = rows(got), rows(want)
    if ca != cb:
        return took, len(got), False, f"columns {ca} {cb}"
    if a != b:
        only = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return took, len(got), False, f"{len(a)} {len(b)} rows; first difference {only}"
    return took, len(got), True, ""


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


if __name__ == "__main__":
    import __spark_entry__ as entry
    from groundlake.session import local_session

    spark, con = local_session(8), connect(sys.argv[1])
    for n in sys.argv[2:] or entry.queries():
        try:
            took, count, same, why = compare(spark, con, entry, sys.argv[1], n)
            print(f"{n:32s} {took:6.1f} s {count:8d} rows  {'SAME' if same else '-' if same is None else 'DIFFERENT'} {why}", flush=True)
        except Exception as e:
            print(f"{n:32s} ERROR {type(e).__name__}: {str(e)[:600]}", flush=True)
