"""A query against its SQL."""

import os

import duckdb

TESTDATA = os.environ.get("WEFTLINE_TESTDATA", "/root/testdata")


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con, folder = duckdb.connect(), f"{TESTDATA}/{sf}"
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return con


def value(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


def assert_same(df, con, sql):
    found = con.sql(sql)
    columns = found.columns
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())
