"""The registered queries: those with SQL against it, and what all must return."""

import glob
import os
import re

import duckdb
import pytest
from conftest import SMALL

from tidewell.llm import queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM parquet_scan('{path}')")
    return con


def test_each_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SMALL)
    said = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in said.description]
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in said.fetchall()), key=str)
