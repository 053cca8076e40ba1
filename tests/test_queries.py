"""Every registered query with SQL must give the SQL's rows; the others must give rows."""

import os

import pytest

import __spark_entry__ as entry
from oracle import differences, duck

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        note = differences(spark, con, FOLDER, QUERIES[name], SQL[name])
        assert note in (None, "no rows"), note
    else:
        assert QUERIES[name](spark, FOLDER).collect()


def test_flagship(spark):
    df = entry.entry(spark)
    assert "slope" in df.columns and df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
