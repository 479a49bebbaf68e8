"""Every query with SQL must equal the SQL answer; the others must run and return rows."""

import os

import pytest
from oracle import compare, connect

from cellgraph.plans import catalog

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES = catalog.load_all()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    q = QUERIES[name]
    df = catalog.spark_callable(q)(spark, FOLDER)
    if q.sql:
        assert compare(df, con, q.sql) is None
    else:
        assert df.columns and df.collect() is not None
