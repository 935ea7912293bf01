"""Compare registered queries with their SQL over a data folder: python tests/compare.py FOLDER [NAME...]."""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, folder, name, query, sql):
    """Difference between the query's rows and those of its SQL; empty if none."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        at = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{at}')")
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = rows_of(want_names, cur.fetchall())
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(want_names):
        return f"columns {df.columns} and {want_names}"
    if got != want:
        extra = [x for x in got if x not in set(want)][:3] if len(got) < 50000 else []
        lack = [x for x in want if x not in set(got)][:3] if len(got) < 50000 else []
        return f"{len(got)} and {len(want)} rows; only here {extra}; only in SQL {lack}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as e
    from sedimenta.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    qs, sq = e.queries(), e.oracle_sql()
    for n in sys.argv[2:] or qs:
        t = time.time()
        try:
            if n in sq:
                print(n, compare(spark, sys.argv[1], n, qs[n], sq[n]) or "same", f"{time.time() - t:.1f}s", flush=True)
            else:
                print(n, "no SQL, rows:", qs[n](spark, sys.argv[1]).count(), f"{time.time() - t:.1f}s", flush=True)
        except Exception as x:
            print(n, "ERROR", str(x)[:900], flush=True)
