"""The filter audit against plain Python and its SQL."""

import itertools

import duckdb
import pytest

from tests.compare import same
from weft.llm import audit as X

DOCS = "doc_id long, text string, lang string, n int, good boolean"
LABELS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"w{i}" for i in range(210))


def brute(rows, labels):
    """Every document through every order."""
    fails = []
    for i, t, lang in rows:
        t = t or ""
        words = t.encode().split()
        fails.append((lang or "", i, {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum(c.isascii() and c.isupper() for c in t) > 3 * len(t),
            "D": bool(set(t) & set("#$%&*|")), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    out = {}
    for part in {p for p, _, _ in fails}:
        own = [(i, f) for p, i, f in fails if p == part]
        for order in itertools.permutations("ABCDE"):
            here = own
            for step, k in enumerate(order, 1):
                gone = [x for x in here if x[1][k]]
                here = [x for x in here if not x[1][k]]
                failing = [f for _, f in own if f[k]]
                lost = lambda ids: sum(i is not None and i in ids for i, _ in gone)  # noqa: B023, E731
                out[part, "".join(order), step] = [len(here), len(gone), len(failing) - len(gone), sum(sum(f.values()) == 1 for f in failing), lost(good), lost(toxic)]
    share = {}
    for (part, order, step), v in out.items():
        share[part, order[step - 1]] = share.get((part, order[step - 1]), 0) + v[1]
    return sorted((*k, *v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items())


ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (3, LONG, None), (None, LONG, "en"), (None, LONG, "de"), (4, None, "de"), (5, "", ""), (6, "a b c", "en"),
    (7, "word " * 250, "en"), (8, LONG.upper(), "de"), (9, LONG + " 5%", "en"), (10, "ABC # " * 300, "de"), (10, "other", "de"), (11, "ÀÉ " + LONG, "fr"), (12, LONG.replace(" ", " "), "fr"),
    (13, LONG.replace(" ", "\x0b\n"), "fr"), (14, LONG + " 5%", "de"), (9, LONG + " 5%", "en"),
]
MARKS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (9, 1, None), (10, None, 1), (None, 1, 1), (4, 1, 1), (99, 1, 1)]


def run(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, lang, 7, None) for i, t, lang in rows], DOCS)
    return X.audit(docs, spark.createDataFrame(labels, LABELS))


def test_against_plain_python(spark):
    df = run(spark, ROWS, MARKS)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, df.select(columns).collect())) == brute(ROWS, MARKS)
    assert dict(df.dtypes) | {"step": "int", "kept": "bigint", "shapley": "bigint"} == dict(df.dtypes)


def test_empty_tables(spark):
    assert run(spark, [], MARKS).collect() == []
    assert run(spark, ROWS[:1], []).count() == 600


@pytest.mark.parametrize("where", ["tables", "sf"])
def test_sql(spark, sf_small, tmp_path, where):
    con = duckdb.connect()
    docs, labels = spark.read.parquet(f"{sf_small}/documents.parquet"), spark.read.parquet(f"{sf_small}/labels.parquet")
    if where == "tables":
        docs, labels = spark.createDataFrame([(i, t, lang, 7, None) for i, t, lang in ROWS], DOCS), spark.createDataFrame(MARKS, LABELS)
    for name, df in (("documents", docs), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}")
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}/*.parquet'")
    same(X.audit(docs, labels), con.sql(X.oracle()))
