"""Every registered query against its SQL on the smallest tables."""

import importlib.util

import pytest

import __spark_entry__
from tests.compare import connect, same
from weft.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_small):
    return connect(sf_small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_small, con, name):
    df = QUERIES[name](spark, sf_small)
    if name in ORACLES:
        same(df, con.sql(ORACLES[name]))
    else:
        assert df.count()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count()
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    found = importlib.util.find_spec("weft.llm") is not None and importlib.util.find_spec("weft.llm.queries") is not None
    assert any(n.startswith("op1_") for n in __spark_entry__.queries()) == found
