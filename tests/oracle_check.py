"""Compare every catalog query with its SQL on DuckDB, ignoring row order."""

from __future__ import annotations

import math
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, int):
        return repr(value)
    return str(value)


def differences(spark, connection, query, sql: str, sf_dir: str) -> tuple[str, float]:
    """An empty text when both sides agree, and the Spark time."""
    started = time.time()
    result = query(spark, sf_dir)
    names = sorted(result.columns)
    ours = [tuple(_plain(row[c]) for c in names) for row in result.collect()]
    elapsed = time.time() - started
    relation = connection.execute(sql)
    theirs_names = [c[0] for c in relation.description]
    if sorted(theirs_names) != names:
        return f"columns {names} != {sorted(theirs_names)}", elapsed
    at = [theirs_names.index(c) for c in names]
    theirs = [tuple(_plain(row[i]) for i in at) for row in relation.fetchall()]
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}", elapsed
    left, right = sorted(ours), sorted(theirs)
    if left != right:
        wrong = [(a, b) for a, b in zip(left, right) if a != b]
        return f"{len(wrong)} rows differ, first: {names} {wrong[0]}", elapsed
    return "", elapsed
