"""Compare a Spark result with DuckDB's, whatever the order of rows and columns."""

import os

import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf=SF):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"create view {t} as select * from read_parquet('{p}')")
    return c


def _text(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_" or type(v).__name__ == "bool":
        return str(bool(v))
    if isinstance(v, int | float) or hasattr(v, "__float__"):
        return repr(round(float(v), 9) + 0.0)
    return str(v)


def normal(df):
    cols = sorted(df.columns)
    out = pd.DataFrame({c: [_text(v) for v in df[c].astype(object)] for c in cols})
    return out.sort_values(cols).reset_index(drop=True)


def same(a, b):
    a, b = normal(a), normal(b)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    pd.testing.assert_frame_equal(a, b)
