"""Piece segmentation against listing every path, and an exact round trip."""

import itertools
import random

import pytest
import sentencepiece

from weft.llm import pieces as P


def all_paths(chunk, p):
    edges = P.lattice(chunk, p)
    paths = [[(0.0, ())]] + [[] for _ in chunk]
    for end in range(1, len(chunk) + 1):
        for start, w, i in edges[end]:
            ids = (i,) if i >= 0 else tuple(p.byte[b] for b in chunk[start:end].encode())
            paths[end] += [(s + w, done + ids) for s, done in paths[start]]
    return sorted(paths[-1], key=lambda x: -x[0])


@pytest.fixture(scope="module")
def p():
    return P.load()


WORDS = ["▁the", "▁thnntly", "éeauou", "▁", "\n", "▁▁▁x", "日本", "a", "erinthan", "▁🙂q", "====", "ñ"]


@pytest.mark.parametrize("chunk", WORDS)
def test_search_and_batch_match_all_paths(p, chunk):
    paths = all_paths(chunk, p)
    for n in (1, 2, 5):
        got = P.n_best(chunk, p, n)
        assert [s for s, _ in got] == [s for s, _ in paths[:n]]
        assert len({ids for _, ids in got}) == len(got)
        assert all(g in paths for g in got)
    (score, ids, second), = P.batch_best([chunk], p)
    assert (score, ids) in paths and score == paths[0][0]
    assert second == (paths[1][0] if len(paths) > 1 else -float("inf"))


def test_merge_matches_all_combinations(p):
    rng = random.Random(1)
    for _ in range(20):
        chunks = [rng.choice(WORDS[:4] + WORDS[7:8]) for _ in range(4)]
        best = [P.batch_best([c], p)[0] for c in chunks]
        got = P.merge(chunks, best, p, 4)
        top = [all_paths(c, p)[:6] for c in chunks]
        want = sorted((sum(s for s, _ in combo) for combo in itertools.product(*top)), reverse=True)[:4]
        assert [s for s, _ in got] == want


def test_round_trip_nulls_and_long_texts(spark):
    long = "x" * 30000
    texts = ["hello world", "", None, "  two  spaces\n\nand\tbreaks \r\n", long, "日本語🙂 ñandú", "a▁b", "same", "same", "=" * 500, "\x00\x07"]
    rows = list(enumerate(texts)) + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as score")
    out = {r.doc_id: r for r in P.encode(docs).collect()}
    back = {r.doc_id: r.text for r in P.decode(P.encode(docs)).collect()}
    for i, t in rows:
        assert out[i].round_trip == ("▁" not in (t or ""))
        if "▁" not in (t or ""):
            assert back[i] == (t or "")
    assert out[7].ids == out[8].ids and out[1].n_best == [0.0]
    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    for i, t in rows:
        if t and "\x00" not in t:
            assert sp.decode(out[i].ids) == t.replace("▁", " ")
    assert P.encode(docs.limit(0)).count() == 0


def test_query_returns_ids_that_decode_to_the_texts(spark, sf_small):
    from weft.llm.queries import op10_sentencepiece

    out = op10_sentencepiece(spark, sf_small)
    back = {r.doc_id: r.text for r in P.decode(out).collect()}
    for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect():
        assert "▁" in (r.text or "") or back[r.doc_id] == (r.text or "")
    assert out.where("size(ids) != n_ids").count() == 0


def test_segmentations_are_made_once_and_kept_in_arrays(p, monkeypatch):
    chunks = WORDS + ["▁the", "x" * 200, "日本", "▁🙂é\x00"]
    made, real = [], P.viterbi
    monkeypatch.setattr(P, "viterbi", lambda some, pieces: made.extend(some) or real(some, pieces))
    known = P.Segments(p)
    numbers = known.numbers(chunks)
    assert sorted(made) == sorted({c for c in chunks if len(c) <= P.LONG})
    assert known.numbers(chunks[::-1]).tolist() == numbers[::-1].tolist() and len(made) == len(set(chunks)) - 1
    flat, sizes = known.of(numbers)
    ends = sizes.cumsum().tolist()
    for c, k, low, high in zip(chunks, numbers.tolist(), [0, *ends], ends):
        two = P.n_best(c, p, 2)
        score, ids, second = known.best(k)
        assert tuple(flat[low:high].tolist()) == ids and score == two[0][0] and second == (two[1][0] if len(two) > 1 else -float("inf"))
        assert (score, ids) in P.n_best(c, p, 8) and p.decode(list(ids)) == c.replace("▁", " ").removeprefix(" ")
    known.clear()
    assert known.numbers(["▁the"]).tolist() == [0] and known.best(0)[1] == P.batch_best(["▁the"], p)[0][1]


def test_least_losses_go_first_and_infinite_ones_never():
    import numpy as np

    inf = float("inf")
    assert P.least(np.array([3.0, 1.0, inf, 1.0, 2.0]), 3) == [1, 3, 4]
    assert P.least(np.array([inf, 5.0]), 2) == [1] and P.least(np.array([]), 2) == []
