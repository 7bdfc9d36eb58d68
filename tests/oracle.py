"""Comparison of a query with its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return _plain(v.item()) if hasattr(v, "item") else v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(_plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str)


def sql_rows(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.sql(sql)
    names = list(found.columns)
    columns = sorted(names)
    return columns, sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
