"""Runs a DuckDB twin over the driver's tables and compares rows without order."""

import glob
import os

import duckdb


def rows(sql, sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con.execute(sql).df()


def same(df, sql, sf_dir):
    a, b = df.toPandas(), rows(sql, sf_dir)
    assert sorted(a.columns) == sorted(b.columns)
    c = sorted(a.columns)
    flat = lambda x: sorted(map(str, x[c].astype(str).values.tolist()))
    assert flat(a) == flat(b)
