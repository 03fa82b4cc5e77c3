"""Order-free comparison of a Spark result with its SQL counterpart in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def differences(result: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs: columns, types, row count, values. Values must be equal, not close."""
    relation = connection.execute(sql)
    names = [column[0] for column in relation.description]
    types = {column[0]: str(column[1]) for column in relation.description}
    rows = relation.fetchall()
    found = []
    if sorted(names) != sorted(result.columns):
        return [f"columns: {sorted(result.columns)} but {sorted(names)}"]
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name, kind in result.dtypes:
        if kinds.get(kind) != types[name]:
            found.append(f"type of {name}: {kind} but {types[name]}")
    order = sorted(names)
    picked = [names.index(name) for name in order]
    theirs = Counter(tuple(_plain(row[i]) for i in picked) for row in rows)
    ours = Counter(tuple(_plain(row[name]) for name in order) for row in result.collect())
    if sum(ours.values()) != len(rows):
        found.append(f"rows: {sum(ours.values())} but {len(rows)}")
    if ours != theirs:
        only_ours, only_theirs = list((ours - theirs).elements()), list((theirs - ours).elements())
        def by_text(row):
            return tuple(str(value) for value in row)
        found.append(
            f"values: {len(only_ours)} rows differ; {order}: {sorted(only_ours, key=by_text)[:3]}"
            f" but {sorted(only_theirs, key=by_text)[:3]}"
        )
    return found
