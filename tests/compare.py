"""Compare registered queries with their SQL counterparts on one data folder.

Usage: python tests/compare.py [name-or-module ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, datetime.datetime) and value.tzinfo is not None:
        value = value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return f"{type(value).__name__}:{value!r}"


def differences(spark_df, connection, sql: str) -> list[str]:
    """What is wrong: column names, row counts, then a few differing rows."""
    names = sorted(spark_df.columns)
    result = connection.execute(sql)
    sql_names = [d[0] for d in result.description]
    sql_rows = result.fetchall()
    if names != sorted(sql_names):
        return [f"columns {names} against {sorted(sql_names)}"]
    places = [sql_names.index(n) for n in names]
    right = sorted(tuple(plain(row[p]) for p in places) for row in sql_rows)
    left = sorted(tuple(plain(row[n]) for n in names) for row in (r.asDict() for r in spark_df.collect()))
    if left == right:
        return []
    from collections import Counter

    a, b = Counter(left), Counter(right)
    return [f"rows {len(left)} against {len(right)}"] + [
        f"  {side} only: {dict(zip(names, row))}"
        for side, rest in (("spark", a - b), ("sql", b - a))
        for row in sorted(rest)[:3]
    ]


def main(wanted: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract
    import workload

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle(folder)
    raw, _ = workload.load()
    sql = contract.oracle_sql()
    bad = 0
    for name, query in contract.queries().items():
        module = raw[name].__module__.split(".")[-1] if name in raw else ""
        if wanted and name not in wanted and module not in wanted:
            continue
        began = time.time()
        try:
            df = query(spark, folder)
            if name in sql:
                found = differences(df, connection, sql[name])
                rows = "sql"
            else:
                rows, found = f"{df.count()} rows, no sql", []
        except Exception as error:  # report and go on with the next query
            found, rows = [str(error)[:1500]], "error"
        bad += bool(found)
        print(f"{'BAD' if found else 'ok '} {time.time() - began:6.2f}s {module}.{name} {rows}", *found, sep="\n    " if found else " ", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
