import math
import os

import duckdb
import pytest

from brightloom.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


def plain(rows, columns):
    return sorted((tuple("nan" if isinstance(v := dict(zip(columns, r))[c], float) and math.isnan(v) else v for c in sorted(columns)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    rows = plain([tuple(r) for r in got.collect()], got.columns)
    assert rows
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == sorted(got.columns)
        assert rows == plain(want.fetchall(), want.columns)
