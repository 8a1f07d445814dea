"""Runs a query on Spark and its SQL on DuckDB and compares all rows."""

import glob
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


def rows(columns, found):
    def value(x):
        return round(x, 6) if isinstance(x, float) else x

    return sorted(([(c, value(x)) for c, x in sorted(zip(columns, r, strict=True), key=lambda p: p[0])] for r in found), key=repr)


def assert_same(df, con, sql):
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
