"""Run registered queries and their SQL on the same tables and compare all rows.

    python -m checks.compare [name ...] [--sf /root/testdata/sf0.01]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from attestra.session import local_session
from checks import QUERIES, SQL

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    spark = local_session("8")
    duck = duckdb.connect()
    for name in TABLES:
        duck.execute(f"create view {name} as select * from '{args.sf}/{name}.parquet'")
    bad = []
    for name in args.names or QUERIES:
        begin = time.time()
        try:
            df = QUERIES[name](spark, args.sf)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as error:
            bad.append(name)
            print(f"FAILED {name}: {str(error)[:1500]}", flush=True)
            continue
        took = time.time() - begin
        if name not in SQL:
            print(f"rows   {name}: {len(got)} rows, {took:.1f}s", flush=True)
            continue
        begin = time.time()
        try:
            cursor = duck.execute(SQL[name])
            columns = [d[0] for d in cursor.description]
            odd = [d[0] for d in cursor.description
                   if "DECIMAL" in str(d[1]).upper() or "HUGEINT" in str(d[1]).upper()]
            if odd:
                print("   decimal or huge columns in SQL:", name, odd)
            want = rows_of(columns, cursor.fetchall())
        except Exception as error:
            bad.append(name)
            print(f"SQL FAILED {name}: {str(error)[:1500]}", flush=True)
            continue
        sql_took = time.time() - begin
        if sorted(columns) == sorted(df.columns) and got == want:
            print(f"ok     {name}: {len(got)} rows, {took:.1f}s, sql {sql_took:.1f}s", flush=True)
            continue
        bad.append(name)
        print(f"DIFFER {name}: {len(got)} / {len(want)} rows; columns {sorted(df.columns)} / "
              f"{sorted(columns)}", flush=True)
        shown = 0
        for a, b in zip(got, want):
            if a != b:
                for c, x, y in zip(sorted(columns), a, b):
                    if x != y:
                        print("   ", c, repr(x)[:300], "|", repr(y)[:300])
                shown += 1
                if shown == 3:
                    break
    print("bad:", bad)
    return len(bad)


if __name__ == "__main__":
    raise SystemExit(main())
