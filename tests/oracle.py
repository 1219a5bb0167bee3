"""Compare a registered query with its oracle: names, types, rows, values."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

# Spark type -> the type names DuckDB reports for the same column.
SAME = {
    "int": {"INTEGER"},
    "bigint": {"BIGINT"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
    "timestamp_ntz": {"TIMESTAMP"},
    "array<string>": {"VARCHAR[]"},
}


def connect(folder: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def compare(frame, connection, sql: str) -> list[str]:
    """Differences between a Spark frame and an oracle query; empty when they agree."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    kinds = {column[0]: str(column[1]) for column in result.description}
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} != {sorted(names)}"]
    problems = []
    for name, kind in frame.dtypes:
        if kinds[name] not in SAME.get(kind, {kind}):
            problems.append(f"type of {name}: {kind} != {kinds[name]}")
    order = sorted(names)
    at = [names.index(name) for name in order]
    theirs = Counter(tuple(_plain(row[i]) for i in at) for row in result.fetchall())
    ours = Counter(
        tuple(_plain(value) for value in row) for row in frame.select(*[f"`{c}`" for c in order]).collect()
    )
    if ours != theirs:
        extra, lacking = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
        problems.append(
            f"{sum(ours.values())} rows != {sum(theirs.values())} rows; {order}\n"
            f"  only ours {extra}\n  only theirs {lacking}"
        )
    return problems
