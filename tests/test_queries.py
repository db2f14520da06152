"""Every query that has SQL gives the SQL's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lakesearch import queries as core

FOLDER = Path("/root/testdata/sf0.001")
QUERIES, SQL = core.QUERIES, core.SQL
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


def canonical(df):
    def cell(x):
        if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
            return str([cell(y) for y in x])
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
            return ""
        return f"{float(x):.6g}" if "float" in type(x).__name__ else str(x)

    return sorted(tuple(cell(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(FOLDER)).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)
