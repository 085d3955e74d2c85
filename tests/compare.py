"""Compare a Spark result with the SQL result of another engine, whatever the row order."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from outage_spark.sources.standins import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(spark_df, con, sql: str) -> int:
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    expected = rows_of(columns, result.fetchall())
    assert sorted(spark_df.columns) == sorted(columns)
    actual = rows_of(spark_df.columns, spark_df.collect())
    assert len(actual) == len(expected), f"{len(actual)} rows, expected {len(expected)}"
    different = [(a, e) for a, e in zip(actual, expected) if a != e]
    assert not different, f"{len(different)} rows differ, first: {str(different[0])[:800]}"
    kinds = [{type(v) for v in column if v is not None} for column in zip(*expected)]
    ours = [{type(v) for v in column if v is not None} for column in zip(*actual)]
    assert ours == kinds, f"types {ours}, expected {kinds}"
    return len(actual)
