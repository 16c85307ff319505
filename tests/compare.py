"""Compare registered Spark queries with their SQL counterparts in DuckDB.

Run as `python -m tests.compare [folder] [query ...]`.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        path = f"{folder}/{table}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if value is None:
        return ""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return str(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def difference(df, connection, sql: str) -> str | None:
    """None if both give the same columns, types and rows, else what differs."""
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    names = {
        "bigint": {"BIGINT"},
        "int": {"INTEGER"},
        "double": {"DOUBLE"},
        "string": {"VARCHAR"},
        "boolean": {"BOOLEAN"},
        "timestamp_ntz": {"TIMESTAMP"},
    }
    for name, kind in df.dtypes:
        if kinds[name] not in names.get(kind, {kinds[name]}):
            return f"type of {name}: {kind} against {kinds[name]}"
    found = sorted_rows(df.columns, df.collect())
    wanted = sorted_rows(columns, expected)
    if len(found) != len(wanted):
        return f"{len(found)} rows against {len(wanted)}"
    wrong = [(a, b) for a, b in zip(found, wanted) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(found)} rows differ, such as {wrong[0]}"
    return None


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from ontide.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = build_session(
        "compare",
        spark__master="local[8]",
        spark__driver__memory="16g",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in chosen or queries:
        started = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problem = difference(df, connection, oracles[name])
            else:
                problem = f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001 - a report of every failure
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        if problem and not problem.startswith("rows only"):
            failed += 1
        print(f"{name:32} {time.time() - started:6.1f}s {problem or 'ok'}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
