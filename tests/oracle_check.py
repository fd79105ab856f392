"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Mirrors the driver's gate: row count, column names, order-insensitive values.
Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""
from __future__ import annotations

import decimal
import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v == v else "NaN"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(norm(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    from fieldloom.sources.tables import TABLES
    con = duckdb.connect()
    for n in TABLES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf_dir}/{n}.parquet')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from fieldloom.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            scols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:800]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in orc:
            print(f"ROWS {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(orc[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:800]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {name}: columns differ spark={sorted(scols)} duck={sorted(dcols)}")
            bad += 1
            continue
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        if a == b:
            h = hashlib.sha256("\n".join(a).encode()).hexdigest()[:12]
            print(f"OK   {name}: {len(a)} rows {ts:.1f}s {h}")
        else:
            bad += 1
            sa, sb = set(a), set(b)
            print(f"FAIL {name}: spark {len(a)} rows, duck {len(b)} rows; only-spark {len(sa - sb)}, only-duck {len(sb - sa)}")
            print("   cols:", sorted(scols))
            for x in sorted(sa - sb)[:3]:
                print("   S:", x[:400])
            for x in sorted(sb - sa)[:3]:
                print("   D:", x[:400])
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
