"""Compares a query with its SQL the way the driver does: rows as multisets, columns by name."""

import math
import os

import duckdb
import pandas as pd


def _plain(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    return x


def _rows(frame):
    cols = sorted(frame.columns)
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else "") for v in r)
    return cols, sorted((tuple(map(_plain, r)) for r in frame[cols].itertuples(index=False, name=None)), key=key)


def tables(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


def same(spark_frame, sql, connection):
    assert _rows(spark_frame.toPandas()) == _rows(connection.execute(sql).df())
