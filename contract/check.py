"""Run registered queries beside their checking SQL and compare the rows."""

from __future__ import annotations

import datetime
import math
import sys
import time
import traceback

import duckdb
from pyspark.sql import DataFrame, SparkSession

from contract.oracles import ORACLES
from contract.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def _value(item):
    if isinstance(item, float):
        return None if math.isnan(item) else round(item, 9)
    if isinstance(item, datetime.datetime):
        return item.replace(tzinfo=None)
    return item


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda place: columns[place])
    return sorted((tuple(_value(row[place]) for place in order) for row in rows), key=repr)


def compare(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when both agree, otherwise what differs."""
    expected = connection.execute(sql)
    names = [column[0] for column in expected.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} but expected {sorted(names)}"
    want, got = rows_of(names, expected.fetchall()), rows_of(df.columns, df.collect())
    if len(want) != len(got):
        return f"{len(got)} rows but expected {len(want)}"
    for ours, theirs in zip(got, want):
        if ours != theirs:
            return f"first difference (columns {sorted(names)}):\n    got      {ours}\n    expected {theirs}"
    return ""


def run(spark: SparkSession, folder: str, names: list[str]) -> int:
    connection, failed = database(folder), 0
    for name in names or QUERIES:
        begin = time.time()
        try:
            df = QUERIES[name](spark, folder)
            found = compare(df, connection, ORACLES[name]) if name in ORACLES else f"rows only: {df.count()}"
            bad = bool(found) and name in ORACLES
        except Exception:
            found, bad = traceback.format_exc(limit=-3)[-1800:], True
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - begin:.1f}s {found}", flush=True)
    return failed


if __name__ == "__main__":
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    sys.exit(run(session, sys.argv[1], sys.argv[2:]) > 0)
