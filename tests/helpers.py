"""Comparison of a Spark result with plain SQL over the same tables."""

import math
import os

import duckdb
import pandas as pd


def plain(x):
    """A value as both engines would give it: whole numbers as int, others rounded, all nulls alike."""
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if isinstance(x, str):
        return x
    if "bool" in type(x).__name__:
        return bool(x)
    if hasattr(x, "__len__"):
        return [plain(v) for v in x]
    f = float(x)
    if math.isnan(f):
        return None
    return int(x) if f == int(f) else round(f, 5)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in frame.itertuples(index=False, name=None))


def same_rows(df, sql, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    want, got = con.execute(sql).df(), df.toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows_of(got) == rows_of(want)
