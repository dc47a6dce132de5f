"""Top ranks from short lists against the ranking of all items."""

import random

import pytest

from weft.operators import retrieval


def tables(spark, seed, n=260, coarse=True):
    rng = random.Random(seed)
    words = [f"term{k}" for k in range(12)]
    vector = lambda: [float(rng.randrange(-2, 3)) if coarse else rng.gauss(0, 1) for _ in range(4)]
    items = [(k, rng.sample(words, rng.randrange(0, 5)), None if rng.random() < 0.2 else vector(), rng.randrange(4)) for k in range(n)]
    questions = [(q, " ".join(rng.sample(words, rng.randrange(1, 6))), None if q % 5 == 4 else vector()) for q in range(14)] + [(50, "", vector()), (51, "??", None), (52, "unknownword", vector())]
    chunks = [(k, rng.choice([None, k % 30, 10_000 + k]), vector()) for k in range(0 if seed == 3 else 90)]
    return (
        spark.createDataFrame(questions, "qid long, text string, qvec array<double>"),
        spark.createDataFrame(items, "id long, words array<string>, emb array<double>, importance int"),
        spark.createDataFrame(chunks, "chunk_id long, id long, emb array<double>"),
    )


@pytest.mark.parametrize(("seed", "size", "coarse"), [(1, 20, True), (2, 60, False), (3, 30, False), (4, 400, True)])
def test_top_is_the_start_of_the_whole_ranking(spark, monkeypatch, seed, size, coarse):
    q, items, chunks = (t.cache() for t in tables(spark, seed, coarse=coarse))
    want = {tuple(r) for r in retrieval.hybrid(q, items, chunks, 6).where("place <= 7").collect()}
    again, whole = [], retrieval.hybrid
    monkeypatch.setattr(retrieval, "hybrid", lambda questions, *a: (again.append(questions.count()), whole(questions, *a))[1])
    got = [tuple(r) for r in retrieval.top(q, items, chunks, 7, size, limit=6).collect()]
    assert len(got) == 17 * 7 and set(got) == want
    if size > 50:
        assert sum(again) < 9  # most questions are settled by the bound


def test_few_items(spark):
    q, items, chunks = tables(spark, 5, n=4)
    want = {tuple(r) for r in retrieval.hybrid(q, items, chunks, 6).collect()}
    assert {tuple(r) for r in retrieval.top(q, items, chunks, 7, 20, limit=6).collect()} == want
    assert retrieval.top(q, items.limit(0), chunks, 7, 20, limit=6).collect() == []
