"""Runs a query and its SQL and compares them as multisets of rows."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) else str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False, name=None)), key=repr)


def same(spark, sf_dir, query, sql):
    a, b = query(spark, sf_dir).toPandas(), connection(sf_dir).execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
