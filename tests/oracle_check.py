"""Run registered Spark queries and their DuckDB oracle side by side.

Usage: python tests/oracle_check.py [sf_dir] [name ...]

Mirrors the driver's comparison: row count, sorted column names, and an
order-insensitive hash of the values (floats rounded to 2 decimals).
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    import datetime
    import decimal
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.2f}"
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and "/" in argv[1] else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if "/" not in a]
    import __spark_entry__ as E
    from promolens.session import local_session
    spark = local_session()
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in (names or sorted(qs)):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in sql:
            print(f"ROWS {name}: {len(rows)} rows (no oracle) {t1 - t0:.1f}s")
            continue
        try:
            cur = con.execute(sql[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        ok_cols = sorted(cols) == sorted(dcols)
        ok_n = len(rows) == len(drows)
        ok_h = ok_cols and digest(cols, rows) == digest(dcols, drows)
        status = "OK  " if (ok_cols and ok_n and ok_h) else "FAIL"
        if status == "FAIL":
            bad += 1
        print(f"{status} {name}: rows {len(rows)}/{len(drows)} cols={'ok' if ok_cols else (sorted(set(cols) ^ set(dcols)))} "
              f"hash={'ok' if ok_h else 'DIFF'} {t1 - t0:.1f}s")
        if status == "FAIL" and ok_cols and os.environ.get("SHOW_DIFF"):
            order = sorted(range(len(cols)), key=lambda i: cols[i])
            dorder = sorted(range(len(dcols)), key=lambda i: dcols[i])
            a = {"|".join(_norm(r[i]) for i in order) for r in rows}
            b = {"|".join(_norm(r[i]) for i in dorder) for r in drows}
            print("   cols:", [cols[i] for i in order])
            for x in sorted(a - b)[:5]:
                print("   spark only:", x)
            for x in sorted(b - a)[:5]:
                print("   duck  only:", x)
    print(f"{bad} failing")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
