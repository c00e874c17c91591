"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from folkmoot.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool) or "bool" in type(v).__name__:
        return str(bool(v))
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return v if isinstance(v, str) else f"{float(v):.6g}"


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.SQL:
        assert rows(got) == rows(duck.sql(registry.SQL[name]).df())
    else:
        assert len(got.columns) and len(got)
