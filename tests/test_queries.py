"""Every query of the store's operators against its SQL, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from quillstore.plans import queries
from quillstore.plans import store_queries as _  # registers its own

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def rows_of(values):
    return sorted((tuple(float(x) if isinstance(x, decimal.Decimal) else x for x in r) for r in values), key=str)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    want = duck.execute(f"select {', '.join(names)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert rows_of(tuple(r[c] for c in names) for r in got.collect()) == rows_of(want)
