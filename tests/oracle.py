"""Rows of a query against rows of its SQL in DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = df[c].dtype.kind
        if kind in "iuf" or str(df[c].dtype) in ("Int32", "Int64"):
            df[c] = df[c].astype("float64").map(lambda v: "null" if v != v else f"{v:.9g}")
        elif kind == "M":
            df[c] = df[c].astype("datetime64[us]").astype(str)
        else:
            df[c] = df[c].map(lambda v: "null" if v is None or v is pd.NA or v != v else str(v))
    return sorted(map(tuple, df.values.tolist()))


def same(spark, sf, query, sql):
    got, wanted = query(spark, sf).toPandas(), connection(sf).execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)
