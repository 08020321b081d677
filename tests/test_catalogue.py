"""Every query of the catalogue against its SQL on the same tables."""

import glob
import os

import duckdb
import pytest
from conftest import SMALL

from tidewell.plans import catalogue


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM parquet_scan('{path}')")
    return con


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SMALL)
    said = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in said.description]
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in df.columns]
    want = sorted((tuple(r[i] for i in order) for r in said.fetchall()), key=str)
    assert sorted(map(tuple, df.collect()), key=str) == want
