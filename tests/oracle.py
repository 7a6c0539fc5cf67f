"""Holds a query's result against its SQL in DuckDB."""

import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple((k, plain(x)) for k, x in sorted(v.asDict().items()))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return v


def database(folder):
    con = duckdb.connect(config={"threads": 2})
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def same(df, con, sql):
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    expected = sorted(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in got.fetchall())
    actual = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    assert actual == expected
