"""Run catalog queries against DuckDB on the same parquet tables.

``python -m tests.oracle [-v] [sf] [name-prefix …]``
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

DATA = os.environ.get("PANELMILL_DATA", "/root/testdata")


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str):
    t = time.time()
    got = df.collect()
    compare.spark_s = time.time() - t
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(want_cols), (df.columns, want_cols)
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(want_cols, want)
    if a == b:
        return len(a), []
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return len(a), [f"rows spark={len(a)} duck={len(b)}", *[f"spark {r}" for r in only_a[:4]], *[f"duck  {r}" for r in only_b[:4]]]


def main(argv):
    import __spark_entry__ as entry
    from panelmill.session import local_session

    verbose = "-v" in argv
    args = [a for a in argv if a != "-v"]
    sf = args[0] if args and args[0].startswith("sf") else "sf0.01"
    names = [a for a in args if not a.startswith("sf0")]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, f"{DATA}/{sf}")
            if name in oracle:
                n, diff = compare(df, con, oracle[name])
            else:
                rows = df.collect()
                n, diff = len(rows), []
                if verbose:
                    for r in rows[:6]:
                        print("   ", r)
        except Exception as e:  # noqa: BLE001
            n, diff = -1, [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(diff)
        state = "FAIL" if diff else ("ok  " if name in oracle else "rows")
        print(f"{state} {name:34s} {n:7d} rows {time.time() - t:6.2f}s (spark run {getattr(compare, "spark_s", 0):.2f}s)", flush=True)
        for d in diff:
            print("     ", d[:1500])
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
