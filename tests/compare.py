"""Run registered queries beside their SQL twins and report differences.

    python tests/compare.py [sf_dir] [key prefix ...]
"""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sf_dir):
    df = query.build(spark, sf_dir)
    spark_rows = [tuple(r) for r in df.collect()]
    left = normal(df.columns, spark_rows)
    if query.sql is None:
        return len(spark_rows), "rows-only" if spark_rows else "EMPTY"
    cursor = con.execute(query.sql)
    names = [d[0] for d in cursor.description]
    right = normal(names, cursor.fetchall())
    if left[0] != right[0]:
        return len(spark_rows), f"COLUMNS {left[0]} vs {right[0]}"
    if len(left[1]) != len(right[1]):
        return len(spark_rows), f"ROWS {len(left[1])} vs {len(right[1])}"
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if bad:
        return len(spark_rows), f"VALUES {len(bad)} differ, e.g.\n   {bad[0][0]}\n   {bad[0][1]}"
    return len(spark_rows), "ok" if spark_rows else "EMPTY"


def main() -> int:
    from causal_panel.plans import all_queries
    from causal_panel.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session("compare"), connect(sf_dir)
    failures = 0
    for key, query in all_queries().items():
        if args and not any(key.startswith(a) for a in args):
            continue
        began = time.time()
        try:
            rows, status = compare(spark, con, query, sf_dir)
        except Exception as error:  # report and go on to the next query
            rows, status = -1, f"ERROR {type(error).__name__}: {str(error)[:900]}"
        failures += status not in ("ok", "rows-only")
        print(f"{key:40s} {rows:7d} {time.time() - began:6.2f}s  {status}", flush=True)
    print("failures", failures)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
