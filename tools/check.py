"""Run registered queries and their DuckDB checks side by side.

    python tools/check.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import importlib
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb

from formsift.session import build_session
from formsift.sources.fixtures import BASE_TABLES


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir, name, catalog):
    start = time.perf_counter()
    df = catalog.QUERIES[name](spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    spent = time.perf_counter() - start
    if name not in catalog.CHECKS:
        return f"rows-only {len(got[1])}", spent, bool(got[1])
    cur = con.execute(catalog.CHECKS[name])
    want = normal([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return f"equal {len(got[1])}", spent, True
    only_spark = [x for x in got[1] if x not in set(want[1])][:3]
    only_duck = [x for x in want[1] if x not in set(got[1])][:3]
    return (f"DIFF columns {got[0]} / {want[0]} rows {len(got[1])} / {len(want[1])}\n"
            f"   spark {only_spark}\n   check {only_duck}"), spent, False


def main():
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("--module", default="formsift.plans.catalog")
    args.add_argument("names", nargs="*")
    args = args.parse_args()
    catalog = importlib.import_module(args.module)
    from formsift.plans import registry
    spark, con, bad = build_session("check"), duck(args.sf), 0
    for name in registry.QUERIES:
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            message, spent, ok = compare(spark, con, args.sf, name, registry)
        except Exception as exc:
            message, spent, ok = f"ERROR {type(exc).__name__}: {str(exc)[:700]}", 0.0, False
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {spent:.2f}s {message}", flush=True)
    print("bad:", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
