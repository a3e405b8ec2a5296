"""Helpers for comparing rows."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def text(value):
    if value is None:
        return "∅"
    if isinstance(value, float):
        return repr(round(value, 6))
    return str(value)


def rows(df, columns=None):
    names = sorted(df.columns) if columns is None else columns
    return sorted(tuple(text(x) for x in r) for r in df.select(*[f"`{c}`" for c in names]).collect())


def duck(folder=DATA):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def sql_rows(con, query, columns):
    found = con.sql(query)
    assert sorted(found.columns) == columns, (found.columns, columns)
    at = [found.columns.index(c) for c in columns]
    return sorted(tuple(text(r[i]) for i in at) for r in found.fetchall())
