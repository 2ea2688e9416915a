"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

    python scripts/check_oracle.py [--sf /root/testdata/sf0.01] [name-prefix ...]

Rows are compared order-insensitively after sorting columns by name; values
are normalised (Decimal by value, floats by repr, timestamps ISO).
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from orderflow.plans.registry import ORACLE, QUERIES  # noqa: E402
from orderflow.session import build_session  # noqa: E402
from orderflow.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v == v else "nan"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if v == int(v) and abs(v) < 1e15:
            return str(int(v))
        return repr(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    names = [n for n in QUERIES if not a.names or any(n.startswith(p) for p in a.names)]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, a.sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {n}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in ORACLE:
            print(f"ROWS  {n}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(ORACLE[n])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {n}: duckdb error {str(e)[:600]}")
            bad += 1
            continue
        s, sc = rows_of(scols, srows)
        d, dc = rows_of(dcols, drows)
        if sc != dc:
            print(f"FAIL  {n}: columns differ\n   spark-only {sorted(set(sc) - set(dc))}\n   duck-only {sorted(set(dc) - set(sc))}")
            bad += 1
            continue
        if s == d:
            print(f"OK    {n}: {len(s)} rows {ts:.1f}s")
            continue
        bad += 1
        print(f"FAIL  {n}: spark {len(s)} rows vs duckdb {len(d)} rows")
        ss, ds = set(s), set(d)
        only_s = sorted(ss - ds)[:3]
        only_d = sorted(ds - ss)[:3]
        for x, y in zip(only_s, only_d):
            diffs = [(sc[i], x[i], y[i]) for i in range(len(sc)) if x[i] != y[i]]
            print("   diff:", diffs[:6])
        if not (only_s and only_d):
            print("   spark-only:", only_s[:2], "\n   duck-only:", only_d[:2])
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
