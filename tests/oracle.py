"""Runs a registered query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.6f}"
    return value


def normalized(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def spark_rows(df):
    return normalized(df.columns, [tuple(row) for row in df.collect()])


def duck_rows(con, sql: str):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return normalized(columns, cursor.fetchall())


# Spark type name -> the SQL engine's, for the types that results may have.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def type_differences(df, con, sql: str) -> list[str]:
    found = {
        name: kind
        for name, kind, *_ in con.execute(f"DESCRIBE {sql}").fetchall()
    }
    return [
        f"{f.name}: {f.dataType.simpleString()} / {found.get(f.name)}"
        for f in df.schema.fields
        if TYPES.get(f.dataType.simpleString()) != found.get(f.name)
    ]
