"""Run registered queries in Spark and their oracle SQL in DuckDB; compare
row count, column names and an order-insensitive hash of the values.

usage: python tests/oracle_check.py [sf_dir] [query ...]
       ORACLE_STRICT=1 compares doubles by their exact repr (default: 6 decimals)
"""
import hashlib
import math
import os
import sys
import time
import datetime as dt
import decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


STRICT = os.environ.get("ORACLE_STRICT") == "1"


def norm(v):
    if STRICT and isinstance(v, float):
        return repr(v)
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6)) if abs(v) < 1e15 else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6))
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (bool,)):
        return str(v)
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    h = []
    for r in rows:
        h.append("|".join(norm(r[i]) for i in order))
    h.sort()
    return hashlib.sha256("\n".join(h).encode()).hexdigest()[:16], h


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    want = sys.argv[2:]
    import __spark_entry__ as E
    from equitylake.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if want and name not in want:
            continue
        t0 = time.time()
        df = fn(spark, sf)
        cols = df.columns
        rows = [tuple(r) for r in df.collect()]
        t1 = time.time()
        if name not in orc:
            print(f"{name:32s} rows={len(rows):7d} spark={t1-t0:6.2f}s  (no oracle)")
            continue
        res = con.execute(orc[name])
        ocols = [d[0] for d in res.description]
        orows = res.fetchall()
        hs, ls = digest(cols, rows)
        ho, lo = digest(ocols, orows)
        ok = sorted(cols) == sorted(ocols) and len(rows) == len(orows) and hs == ho
        bad += not ok
        print(f"{name:32s} rows={len(rows):7d}/{len(orows):7d} spark={t1-t0:6.2f}s "
              f"{'OK' if ok else 'MISMATCH'}")
        if not ok:
            if sorted(cols) != sorted(ocols):
                print("   cols spark:", sorted(cols), "\n   cols oracle:", sorted(ocols))
            a, b = set(ls), set(lo)
            for x in list(a - b)[:3]:
                print("   spark only :", x[:400])
            for x in list(b - a)[:3]:
                print("   oracle only:", x[:400])
    print("mismatches:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
