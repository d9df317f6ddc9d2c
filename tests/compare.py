"""Runs a query and its oracle side by side, the way the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def kind(data_type: pa.DataType) -> str:
    if pa.types.is_timestamp(data_type):
        return "timestamp"
    if pa.types.is_large_string(data_type):
        return "string"
    return str(data_type)


def canonical(table: pa.Table) -> tuple[list[tuple[str, str]], list[tuple]]:
    names = sorted(table.column_names)
    schema = [(n, kind(table.schema.field(n).type)) for n in names]
    columns = [[_plain(v) for v in table.column(n).to_pylist()] for n in names]
    return schema, sorted(zip(*columns), key=repr)


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


def differences(spark_table: pa.Table, oracle_table: pa.Table) -> list[str]:
    found = []
    (schema_a, rows_a), (schema_b, rows_b) = canonical(spark_table), canonical(oracle_table)
    if schema_a != schema_b:
        found.append(f"schema: {schema_a} / {schema_b}")
    if len(rows_a) != len(rows_b):
        found.append(f"rows: {len(rows_a)} / {len(rows_b)}")
    if rows_a != rows_b:
        only_a, only_b = set(rows_a) - set(rows_b), set(rows_b) - set(rows_a)
        found.append(f"values: {sorted(only_a, key=repr)[:3]} / {sorted(only_b, key=repr)[:3]}")
    return found
