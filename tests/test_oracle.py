"""Every query gives what its SQL gives, over whole tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in SQL:
        assert compare(spark, con, QUERIES[name], SQL[name], sf_dir) == ""
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["dataset", "chunk", "n_files", "n_events", "emitted"] and df.count() > 0
