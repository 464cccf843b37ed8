"""Compare a Spark result with DuckDB's, whatever the order of rows and columns."""

import os
from decimal import Decimal

import duckdb
import pandas as pd


def connection(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, (bool, str)) or type(value).__name__ == "bool":
        return str(value)
    if isinstance(value, (float, Decimal)) or hasattr(value, "dtype") or isinstance(value, int):
        number = float(value) if not hasattr(value, "isoformat") else None
        if number is not None:
            return None if pd.isna(number) else round(number, 6) + 0.0
    return str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(_plain(v) for v in row) for row in frame.itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def assert_same(spark_df, con, sql):
    ours, theirs = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)
