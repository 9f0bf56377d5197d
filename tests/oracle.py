"""Run registered queries beside their SQL on the driver tables.

    python -m tests.oracle [scale directory] [name prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from advertide.plans.inputs import TABLES
from advertide.session import local_session


def plain(value):
    """Values as both engines should spell them."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(repr(plain(row[i])) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def compare(spark, con, sf_dir, name, plan, sql):
    """None when equal, else a short account of the difference; with it row count and seconds."""
    started = time.time()
    df = plan(spark, sf_dir)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    taken = time.time() - started
    if sql is None:
        return None, len(got), taken
    cursor = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}", len(got), taken
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        short = [tuple(v[:200] for v in r) for r in extra], [tuple(v[:200] for v in r) for r in missing]
        return f"{len(got)} vs {len(want)} rows of {got_columns}\n   spark {short[0]}\n   sql   {short[1]}", len(got), taken
    return None, len(got), taken


def main() -> int:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session("oracle")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = []
    for name, plan in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            problem, count, taken = compare(spark, con, sf_dir, name, plan, sqls.get(name))
        except Exception as error:  # a broken query is one more difference to list
            problem, count, taken = f"{type(error).__name__}: {str(error)[:1500]}", 0, 0.0
        mark = "DIFF" if problem else ("ok" if name in sqls else "rows")
        print(f"{mark:5}{name:45}{count:8}{taken:7.2f}s", flush=True)
        if problem:
            bad.append(name)
            print("   ", problem, flush=True)
    print(f"{len(bad)} differ: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
