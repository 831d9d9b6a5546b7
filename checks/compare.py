"""Run registered queries and their twins side by side.

    python -m checks.compare [folder] [name ...]
"""

from __future__ import annotations

import decimal
import glob
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.catalogue import QUERIES
from checks.oracle import ORACLE_SQL

DEFAULT_FOLDER = "/root/testdata/sf0.01"


def _plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return round(value, 6)
    return value


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def rows(columns: list[str], data: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in data)


def compare(
    spark: SparkSession, connection: duckdb.DuckDBPyConnection, folder: str, name: str
) -> str | None:
    """None if both results are equal, else what differs."""
    frame = QUERIES[name](spark, folder)
    ours = [tuple(row) for row in frame.collect()]
    cursor = connection.execute(ORACLE_SQL[name])
    columns = [item[0] for item in cursor.description]
    theirs = cursor.fetchall()
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} / {sorted(columns)}"
    left, right = rows(frame.columns, ours), rows(columns, theirs)
    if left != right:
        only_left, only_right = left - right, right - left
        return (
            f"rows {len(ours)} / {len(theirs)}; only here {list(only_left)[:2]};"
            f" only in the twin {list(only_right)[:2]}"
        )
    return None


def main(arguments: list[str]) -> int:
    folder = arguments[0] if arguments else DEFAULT_FOLDER
    names = arguments[1:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failures = 0
    for name in names:
        start = time.time()
        try:
            difference = compare(spark, connection, folder, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            difference = f"{type(error).__name__}: {str(error)[:600]}"
        failures += difference is not None
        print(f"{'ok  ' if difference is None else 'FAIL'} {name} {time.time() - start:.1f}s"
              f" {difference or ''}", flush=True)
    print(f"{len(names) - failures} of {len(names)} equal")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
