"""Run a query on Spark and its SQL twin on DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime) and value.time() == datetime.time():
        return value.date()
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(plain, key=repr)


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "HUGEINT": "hugeint",
    "BOOLEAN": "boolean",
}


def compare(df, con, sql: str) -> list[str]:
    """Differences between the two results, as text; empty when they agree."""
    spark_columns, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    duck_types = {d[0]: str(d[1]) for d in result.description}
    duck_columns, duck_rows = rows_of(names, result.fetchall())
    problems = []
    if spark_columns != duck_columns:
        return [f"columns {spark_columns} != {duck_columns}"]
    for column, kind in df.dtypes:
        if KINDS.get(duck_types[column], duck_types[column]) != kind:
            problems.append(f"type of {column}: spark {kind}, sql {duck_types[column]}")
    if len(spark_rows) != len(duck_rows):
        problems.append(f"rows {len(spark_rows)} != {len(duck_rows)}")
    bad = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    if bad:
        problems.append(f"{len(bad)} of {len(spark_rows)} rows differ, first: spark {bad[0][0]} sql {bad[0][1]}")
    return problems
