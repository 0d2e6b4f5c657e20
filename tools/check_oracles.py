"""Compare every query with its DuckDB oracle: rows, column names, types, values.

usage: python tools/check_oracles.py [sf_dir] [name ...]   (timings on stdout)
"""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tapeloom.queries import ORACLES, QUERIES  # noqa: E402
from tapeloom.session import build_session  # noqa: E402


def canon(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        v = v.replace(tzinfo=None)
    return str(v)


def table_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    wanted = [n for n in QUERIES if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    spark = build_session("oracle-check", shuffle_partitions=os.environ.get("SHUFFLE", "8"), **{"spark.ui.showConsoleProgress": "false", "spark.log.structuredLogging.enabled": "false"})
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    bad = 0
    for name in wanted:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf)
            rows = df.collect()
            t1 = time.time()
            if name not in ORACLES:
                print(f"{name:34s} rows-only {len(rows):8d} {t1 - t0:6.1f}s", flush=True)
                continue
            cur = con.execute(ORACLES[name])
            names, want = [d[0] for d in cur.description], cur.fetchall()
            types = dict(zip(names, [str(d[1]) for d in cur.description]))
            t2 = time.time()
        except Exception as e:
            bad += 1
            text = str(e).split("JVM stacktrace")[0]
            print(f"{name:34s} ERROR {type(e).__name__} {text[:900]}", flush=True)
            if os.environ.get("TB"):
                traceback.print_exc()
            continue
        if sorted(df.columns) != sorted(names):
            bad += 1
            print(f"{name:34s} COLUMNS spark={sorted(df.columns)} sql={sorted(names)}", flush=True)
            continue
        a, b = table_rows(df.columns, rows), table_rows(names, want)
        if a == b:
            print(f"{name:34s} ok {len(a):8d} spark {t1 - t0:6.1f}s duckdb {t2 - t1:6.1f}s", flush=True)
            continue
        bad += 1
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        print(f"{name:34s} MISMATCH rows {len(a)} vs {len(b)}; differing {len(only_a)} vs {len(only_b)}", flush=True)
        print("   columns", sorted(names), "types", {k: (types[k], dict(df.dtypes)[k]) for k in sorted(names)})
        for x in only_a[:3]:
            print("   spark", x)
        for x in only_b[:3]:
            print("   sql  ", x)
    print("failed:", bad, "of", len(wanted))
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
