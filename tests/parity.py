"""Compares a query's rows with those of its SQL in DuckDB, regardless of order."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "item"):
        return plain(v.item())
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return v


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def sql_rows(c, sql):
    result = c.execute(sql)
    names = [x[0] for x in result.description]
    columns = sorted(names)
    index = [names.index(x) for x in columns]
    return columns, sorted((tuple(plain(r[i]) for i in index) for r in result.fetchall()), key=repr)
