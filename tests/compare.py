"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows.

Usage: python tests/compare.py SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def kind(v) -> str:
    return "int" if isinstance(v, int) and not isinstance(v, bool) else type(v).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def check(spark, con, q, sf_dir):
    """Returns (row count, problem or None)."""
    df = q.run(spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if q.sql is None:
        return len(got), None
    cur = con.execute(q.sql)
    ocols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if cols != ocols:
        return len(got), f"columns {cols} vs {ocols}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} vs {len(want)}"
    for i, c in enumerate(cols):
        a, b = {kind(r[i]) for r in got if r[i] is not None}, {kind(r[i]) for r in want if r[i] is not None}
        if a != b:
            return len(got), f"types of {c}: {a} vs {b}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return len(got), f"{len(bad)} rows differ, first {bad[0]}"
    return len(got), None


def main():
    from plumbline.queries import all_queries
    from plumbline.session import build_session

    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
                              "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf_dir)
    failed = 0
    for name, q in all_queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            n, problem = check(spark, con, q, sf_dir)
        except Exception as e:  # noqa: BLE001
            n, problem = -1, f"{type(e).__name__}: {str(e)[:700]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={n} {time.time() - t:.2f}s {'' if q.sql else '(no sql) '}{problem or ''}", flush=True)
    print("failed:", failed)
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
