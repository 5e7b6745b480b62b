"""Compares a query with its SQL, run by DuckDB on the same tables."""

import numbers

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def _value(v):
    """Whole numbers exactly (also where a null made them floats), others to six digits."""
    if hasattr(v, "__len__"):
        return v if isinstance(v, str) else str(list(v))
    if pd.isna(v):
        return ""
    if isinstance(v, bool) or not isinstance(v, numbers.Real):
        return str(v)
    return str(int(v)) if v == round(v) and abs(v) < 2**53 else f"{float(v):.6g}"


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(_value(v) for v in r) for r in df[cols].itertuples(index=False))


def both(spark, query, sql, data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return rows(query(spark, data).toPandas()), rows(con.sql(sql).df())
