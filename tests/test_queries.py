"""Every query with SQL gives what the SQL gives, and every query runs, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from lodegraph import catalog


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda v: "null" if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v))
    return sorted(map(tuple, df.values.tolist()))


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(folder):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, folder, name):
    got = catalog.QUERIES[name](spark, folder).toPandas()
    if name in catalog.SQL:
        assert rows(got) == rows(duck.execute(catalog.SQL[name]).df())
