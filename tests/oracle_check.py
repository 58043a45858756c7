"""Local mirror of the driver's correctness gate.

Runs every ``queries()`` entry on Spark and its ``oracle_sql()`` text on
DuckDB over the same parquet tables and compares row count, column names
and an order-insensitive hash of the values.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tavola.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def run(sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    from tavola.session import local_session

    spark = local_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    results = {}
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", str(e)[:400])
            print(name, "SPARK_ERROR", str(e)[:400])
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = ("rows-only", len(rows))
            print(f"{name:40s} rows-only {len(rows):7d} rows  {ts:6.2f}s")
            continue
        try:
            rel = con.sql(sqls[name])
            ocols = rel.columns
            orows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("SQL_ERROR", str(e)[:400])
            print(name, "SQL_ERROR", str(e)[:400])
            continue
        h1, l1 = digest(cols, rows)
        h2, l2 = digest(ocols, orows)
        ok = sorted(cols) == sorted(ocols) and len(rows) == len(orows) and h1 == h2
        results[name] = ("OK" if ok else "MISMATCH", len(rows), len(orows))
        print(f"{name:40s} {'OK' if ok else 'MISMATCH':8s} {len(rows):7d} vs {len(orows):7d} rows  {ts:6.2f}s")
        if not ok and verbose:
            if sorted(cols) != sorted(ocols):
                print("   columns:", sorted(cols), sorted(ocols))
            a, b = set(l1), set(l2)
            for x in sorted(a - b)[:3]:
                print("   spark only:", x[:300])
            for x in sorted(b - a)[:3]:
                print("   duck  only:", x[:300])
    return results


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    res = run(sf, set(sys.argv[2:]) or None)
    bad = [k for k, v in res.items() if v[0] not in ("OK", "rows-only")]
    print(f"{len(res) - len(bad)}/{len(res)} passed; failing: {bad}")
