"""Run every registered query in Spark and its oracle SQL in DuckDB; compare.

usage: python tools/oracle_check.py [sf_dir] [name ...]
Prints one line per query (rows, schema, values) and a summary.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from telemetra.plans.session import build_session  # noqa: E402
from telemetra.registry import QUERIES  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(records, cols):
    return sorted((tuple(norm(r[c]) for c in cols) for r in records), key=repr)


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or list(QUERIES)
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    bad = 0
    for name in names:
        build, sql = QUERIES[name]
        t0 = time.time()
        try:
            sdf = build(spark, sf_dir)
            srows = [r.asDict() for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name:24s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if sql is None:
            print(f"{name:24s} rows={len(srows)} (no oracle) {ts:.2f}s")
            continue
        try:
            cur = con.execute(sql)
            dcols = [d[0] for d in cur.description]
            drows = [dict(zip(dcols, r)) for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:24s} DUCKDB ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        cols = sorted(scols)
        ok_cols = cols == sorted(dcols)
        ok_rows = len(srows) == len(drows)
        ok_vals = ok_cols and rows_of(srows, cols) == rows_of(drows, cols)
        status = "OK" if (ok_cols and ok_rows and ok_vals) else "MISMATCH"
        if status != "OK":
            bad += 1
        print(f"{name:24s} {status} rows={len(srows)}/{len(drows)} cols={'ok' if ok_cols else (scols, dcols)} "
              f"vals={'ok' if ok_vals else 'DIFF'} {ts:.2f}s")
        if status != "OK" and ok_cols:
            a, b = rows_of(srows, cols), rows_of(drows, cols)
            sa, sb = set(a), set(b)
            print("   spark-only:", list(sa - sb)[:3])
            print("   duck-only: ", list(sb - sa)[:3])
    print(f"{len(names) - bad}/{len(names)} passed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
