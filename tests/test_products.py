"""Block products against all pairs, and clusters of groups of near copies."""

import random

import numpy as np
import pytest

from weft.operators import products, similarity


def unit(rng, terms, size):
    picked = rng.sample(terms, size)
    w = np.array([rng.random() + 0.1 for _ in picked])
    return sorted(zip(picked, w / np.sqrt((w * w).sum())))


def vectors(seed, n, frequent):
    rng = random.Random(seed)
    terms = [*range(-frequent, 0), *range(60)]
    return [(7 * k, unit(rng, terms, rng.randrange(1, 12))) for k in range(n)]


def dot(x, y):
    y = dict(y)
    return sum(w * y.get(t, 0.0) for t, w in x)


@pytest.mark.parametrize(("held", "frequent"), [(products.HELD, 5), (600, 5), (600, 0)])
def test_close_pairs(monkeypatch, held, frequent):
    monkeypatch.setattr(products, "HELD", max(held, products.DENSE))
    rows = vectors(1, 90, frequent)

    def block(part):
        sizes = [len(e) for _, e in part]
        flat = [x for _, e in part for x in e]
        return products.Vectors(np.array([i for i, _ in part]), np.concatenate([[0], np.cumsum(sizes)]), np.array([t for t, _ in flat]), np.array([w for _, w in flat]))

    left, right = rows[:40], rows[40:]
    got = {(left[a][0], right[b][0]): s for x, y, d in products.close_pairs(block(left), block(right), 0.4) for a, b, s in zip(x, y, d)}
    want = {(i, j): dot(x, y) for i, x in left for j, y in right if dot(x, y) >= 0.4}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_pairs_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(products, "BLOCK_VECTORS", 20)
    rows = vectors(2, 150, 4)
    df = spark.createDataFrame([(i, [t for t, _ in e], [float(w) for _, w in e]) for i, e in rows] + [(None, [1], [1.0])], "id long, terms array<bigint>, weights array<double>")
    got = {(r.a, r.b): r.similarity for r in products.pairs(df, 0.5).collect()}
    want = {(i, j): dot(x, y) for i, x in rows for j, y in rows if i < j and dot(x, y) >= 0.5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    forest = products.pairs(df, 0.5, forest=True).collect()
    assert len(forest) <= len(want) and {(r.a, r.b) for r in forest} <= want.keys()
    assert products.pairs(df.limit(0), 0.5).collect() == []


def test_groups_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"word{k}" for k in range(60)]
    texts = [" ".join([*base, f"own{k}", rng.choice(base)]) for k in range(300)]  # all alike, none equal
    texts += ["", None, "x", texts[0]] + [" ".join(f"z{k}q{j}" for j in range(20)) for k in range(40)]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.cluster for r in similarity.clusters(items).collect()}
    assert len(got) == len(texts) and {got[k] for k in range(300)} | {got[303]} == {0}
    assert got[300] == got[301] == 300 and all(got[k] == k for k in [302, *range(304, 344)])


def test_blocks_meet_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(products, "BLOCK_VECTORS", 20)
    rows = vectors(4, 100, 4)
    df = spark.createDataFrame([(i, [t for t, _ in e], [float(w) for _, w in e]) for i, e in rows], "id long, terms array<bigint>, weights array<double>")
    met = products.pairs(df, 0.5, size=(100, sum(len(e) for _, e in rows)))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan  # a vector is not written again for each block it meets
    want = {(i, j) for i, x in rows for j, y in rows if i < j and dot(x, y) >= 0.5}
    assert {(r.a, r.b) for r in met.collect()} == want


def test_large_vocabularies_are_joined(spark, monkeypatch):
    items = spark.createDataFrame([(k, f"common text number{k // 2} and{k // 2} more{k // 2}") for k in range(40)], "id long, text string")
    small = sorted(map(tuple, similarity.similar_representatives(items, 0.02).collect()))
    monkeypatch.setattr(similarity, "BROADCAST_TERMS", 0)
    assert small == sorted(map(tuple, similarity.similar_representatives(items, 0.02).collect())) and small
