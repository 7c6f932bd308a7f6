"""Row-set comparison of a Spark result with its SQL counterpart."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb

from cohortry.sources.standins import TABLES


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(directory) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _kind(value) -> str:
    return type(value).__name__


def row_counts(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(
        tuple((_kind(row[i]), _plain(row[i])) for i in order) for row in rows
    )


def difference(spark_result, connection, sql: str) -> str | None:
    """Why the two results differ, or None if they are the same rows."""
    cursor = connection.execute(sql)
    sql_columns = [d[0] for d in cursor.description]
    sql_rows = cursor.fetchall()
    columns = spark_result.columns
    if sorted(columns) != sorted(sql_columns):
        return f"columns: spark-only {set(columns) - set(sql_columns)}, sql-only {set(sql_columns) - set(columns)}"
    spark_rows = [tuple(r) for r in spark_result.collect()]
    if len(spark_rows) != len(sql_rows):
        return f"rows: spark {len(spark_rows)}, sql {len(sql_rows)}"
    if not spark_rows:
        return "both results are empty"
    ours, theirs = row_counts(columns, spark_rows), row_counts(sql_columns, sql_rows)
    if ours != theirs:
        names = sorted(columns)
        a, b = next(iter(ours - theirs)), next(iter(theirs - ours))
        return f"values: {sum((ours - theirs).values())} rows differ; {names}\n  spark {a}\n  sql   {b}"
    return None
