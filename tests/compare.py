"""Comparison of a query's rows with those of its DuckDB SQL."""

from __future__ import annotations

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    return round(value, 5) + 0.0 if isinstance(value, float) else value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(df, relation) -> None:
    assert sorted(df.columns) == sorted(relation.columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(relation.columns, relation.fetchall())
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want) if a != b][:3] == []
