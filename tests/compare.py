"""Compares a query with its SQL as the driver does: columns by name, rows in any order."""

import glob
import os

import duckdb
import pandas as pd


def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def same(spark_df, sql, sf_dir):
    a, b = spark_df.toPandas(), duck(sf_dir).execute(sql).fetchdf()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
