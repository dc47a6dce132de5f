"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from weft.llm import ann


def brute(rows, every=50, k=5):
    rows = sorted(rows)
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], dtype=np.float64)
    out = {}
    for i, q in zip(ids, v):
        if i % every == 0:
            s = (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))
            out[int(i)] = sorted((-x, int(j)) for x, j in zip(s, ids) if j != i)[:k]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        found = out.setdefault(r.query_id, [])
        assert r["rank"] == len(found) + 1
        found.append((-r.score, r.vec_id))
    return out


def test_recall_on_the_table(spark):
    emb = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in emb.collect()])
    got = answers(ann.search(emb, probe_least=1))
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    hits = [len({j for _, j in got[q]} & {j for _, j in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.9
    for q, found in got.items():
        assert found == sorted(found)


def test_exact_where_all_cells_are_walked(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(60)] + [(400 + i, [2 * x for x in rows[3][1]]) for i in range(3)]
    odd = [(1000, None), (1050, [0.0] * 6), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1150, [float("nan")] * 6), (1200, [float("inf")] + [0.0] * 5), (1250, []), (1300, [1.0]), (None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as cell", "2 as v", "3 as score")
    want, got = brute(rows), answers(ann.search(df))
    assert got.keys() == want.keys()
    for q in want:
        assert [j for _, j in got[q]] == [j for _, j in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], atol=1e-12)


@pytest.mark.parametrize("rows", [[], [(50, [1.0, 2.0])], [(50, [1.0, 2.0]), (51, [2.0, 1.0])], [(0, [1.0]), (3, [-2.0])]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert answers(ann.search(df)) == {q: [(pytest.approx(s), j) for s, j in f] for q, f in brute(rows).items() if f}


def test_heap_walks_cells_in_order():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(7)
    sizes = np.ones((9, 7), int)
    cells = ann.traverse(a, b, sizes, 63)
    sums = [a[c // 7] + b[c % 7] for c in cells]
    assert sums == sorted(sums) and sorted(cells) == list(range(63))
    assert len(ann.traverse(a, b, sizes, 10)) == 10
