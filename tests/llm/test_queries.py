"""Every registered query of the subpackage runs on the smallest tables, and matches its SQL where it has some."""

import duckdb
import pytest

from weft.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    got = df.collect()
    assert got
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "labels"):
            con.sql(f"create view {t} as select * from '{sf_small}/{t}.parquet'")
        want = con.sql(ORACLES[name])
        assert sorted(want.columns) == sorted(df.columns) and len(want.fetchall()) == len(got)
