"""Compares a query with its SQL on DuckDB: same columns, same rows in any order."""

import math
from pathlib import Path

import duckdb


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(round(float(value), 6))
    return str(value)


def connect(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def assert_same(df, sql, connection):
    relation = connection.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    ours = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    at = [relation.columns.index(n) for n in names]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    assert ours == theirs
