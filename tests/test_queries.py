"""Each query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from larkspur.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(str).replace({r"\.0$": "", "^<NA>$": "nan", "^None$": "nan"}, regex=True)
    return sorted(map(tuple, frame.to_numpy()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    found = QUERIES[name](spark, DATA).toPandas()
    assert len(found), "a query without rows proves nothing"
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)
