"""Rows of a Spark query against those of a DuckDB query."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return "null" if value is None else str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


def same(df, sql, sf_dir):
    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        told = db.sql(sql)
        columns, want = told.columns, told.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want)
