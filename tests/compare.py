"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracewell.session import TABLES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, int):
        return float(value) if abs(value) < 2**53 else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, queries, oracles, name, folder, show=True):
    start = time.time()
    df = queries[name](spark, folder)
    got = df.collect()
    took = time.time() - start
    columns, left = rows_of(df.columns, got)
    if name not in oracles:
        return True, f"{name:24s} rows={len(left):7d} {took:6.2f}s (no oracle)"
    start = time.time()
    cur = con.execute(oracles[name])
    wanted = cur.fetchall()
    sql_took = time.time() - start
    names, right = rows_of([c[0] for c in cur.description], wanted)
    ok = columns == names and left == right
    text = f"{name:24s} rows={len(left):7d} {took:6.2f}s sql={sql_took:5.2f}s {'ok' if ok else 'MISMATCH'}"
    if not ok and show:
        text += f"\n   columns {columns} vs {names}; rows {len(left)} vs {len(right)}"
        a, b = set(map(repr, left)), set(map(repr, right))
        text += "".join(f"\n   spark only: {r[:300]}" for r in sorted(a - b)[:3])
        text += "".join(f"\n   sql only:   {r[:300]}" for r in sorted(b - a)[:3])
    return ok, text


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tracewell.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.tracewell.spreadTasks": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = connect(folder)
    wanted = sys.argv[1:] or list(queries)
    bad = []
    for name in wanted:
        try:
            ok, text = compare(spark, con, queries, oracles, name, folder)
        except Exception as exc:  # report and go on with the next query
            ok, text = False, f"{name:24s} ERROR {type(exc).__name__}: {str(exc)[:1200]}"
        print(text, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
