"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from sigloom import catalogue

catalogue.load()
FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, (float, np.floating)) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v) + 0.0:.9g}"
    return [plain(x) for x in v] if isinstance(v, (list, np.ndarray)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no supplied tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, FOLDER)
    if name not in catalogue.SQL:
        assert got.count() >= 0 and got.columns
        return
    expected = duck.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got.toPandas()) == rows(expected.df())
