"""Compare a Spark result with the result of its SQL twin in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(row[n] for n in names) for row in df.collect()), key=repr)


def sql_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(sql)
    found = [d[0] for d in result.description]
    names = sorted(found)
    places = [found.index(n) for n in names]
    return names, sorted((tuple(row[i] for i in places) for row in result.fetchall()), key=repr)


def sql_types(connection, sql: str) -> dict[str, str]:
    described = connection.execute(f"DESCRIBE {sql}").fetchall()
    return {row[0]: row[1] for row in described}
