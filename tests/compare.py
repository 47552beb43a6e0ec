"""Compare Spark results with DuckDB results as multisets of rows."""

from __future__ import annotations

import collections
import datetime as dt
import decimal
import os
from typing import Any

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = os.path.join(sf_dir, f"{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value: Any) -> Any:
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def bag(columns: list[str], rows: list[tuple]) -> collections.Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(plain(row[i]) for i in order) for row in rows)


def family(name: str) -> str:
    name = name.lower()
    for kind in ("bigint", "string", "varchar", "double", "boolean", "int"):
        if name.startswith(kind):
            return {"varchar": "string"}.get(kind, kind)
    return name


def differences(spark_df, connection, sql: str) -> str | None:
    """A short text about the first difference, None when equal."""
    rows = [tuple(row) for row in spark_df.collect()]
    result = connection.execute(sql)
    columns = [item[0] for item in result.description]
    types = {item[0]: family(str(item[1])) for item in result.description}
    expected = result.fetchall()
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(columns)}"
    got_types = {name: family(kind) for name, kind in spark_df.dtypes}
    if got_types != types:
        return f"types {got_types} != {types}"
    ours, theirs = bag(spark_df.columns, rows), bag(columns, expected)
    if ours == theirs:
        return None if rows else "no rows"
    return (
        f"{len(rows)} rows against {len(expected)}; only here {list((ours - theirs).items())[:3]}, "
        f"only there {list((theirs - ours).items())[:3]}"
    )
