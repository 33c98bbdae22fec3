"""Run registered queries against DuckDB on the same tables.

    python tests/oracle.py [--sf DIR] [name-part ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _normal(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _sortable(row):
    return tuple((v is None, str(type(v).__name__), v if v is not None else 0) for v in row)


SPARK_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


def compare(df, con, sql: str) -> str | None:
    """None if the results agree, else what differs."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} / {sorted(rel.columns)}"
    ours = {n: SPARK_TYPES.get(t, t) for n, t in df.dtypes}
    theirs = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    types = {n: (ours[n], theirs[n]) for n in names if ours[n] != theirs[n]}
    left = sorted((tuple(_normal(r[n]) for n in names) for r in df.collect()), key=_sortable)
    picked = ", ".join(f'"{n}"' for n in names)
    right = rel.project(picked).fetchall()
    right = sorted((tuple(_normal(v) for v in r) for r in right), key=_sortable)
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    if not left:
        return "no rows"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, types {types}: {names} {wrong[0][0]} / {wrong[0][1]}"
    return f"types {types}" if types else None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from conftest import make_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default=f"{TESTDATA}/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con = make_session(), connect(args.sf)
    sql, bad = oracle_sql(), 0
    for name, run in queries().items():
        if args.names and not any(n in name for n in args.names):
            continue
        start = time.time()
        try:
            df = run(spark, args.sf)
            problem = compare(df, con, sql[name])
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
