"""Every query of the library against its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from quillspark import queries as own

SF = "/root/testdata/sf0.001"


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return [normal(x) for x in v]
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query(spark, duck, name):
    df = own.queries()[name](spark, SF)
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    got = [tuple(normal(r[i]) for i in order) for r in df.collect()]
    if name not in own.oracle_sql():
        assert got
        return
    want = duck.sql(own.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    assert sorted(got, key=repr) == sorted((tuple(normal(r[i]) for i in order) for r in want.fetchall()), key=repr)
