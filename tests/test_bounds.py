"""Bounds of block products: few pairs are multiplied whole, none that is close enough is lost; counts and weights as rows of a column would give them."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from weft.operators import products, similarity


def block(rng, n, words, near=0):
    """Vectors like those of texts: frequent terms (below zero) in many, rare ones in few; the last near ones change some of others'."""
    sets = [{-1 - int(2000 * rng.random() ** 3) for _ in range(words)} | {rng.randrange(100_000) for _ in range(words // 4)} for _ in range(n - near)]
    sets += [set(rng.sample(sorted(s), int(0.8 * len(s)))) for s in sets[:near]]
    flat = [(k, t, rng.random() + 0.5) for k, s in enumerate(sets) for t in sorted(s)]
    of, terms, weights = (np.array(c) for c in zip(*flat))
    return products.Vectors(np.arange(n), np.concatenate([[0], np.cumsum(np.bincount(of))]), terms, weights / np.sqrt(np.bincount(of, weights * weights))[of])


def whole(vectors):
    out = np.zeros((len(vectors.ids), len(vectors.terms)))
    out[np.repeat(np.arange(len(vectors.ids)), vectors.sizes), vectors.places] = vectors.weights
    return out @ out.T


@pytest.mark.parametrize(("words", "held"), [(20, 4_000_000), (300, 4_000_000), (300, 20_000)])
def test_few_pairs_are_multiplied_whole(monkeypatch, words, held):
    monkeypatch.setattr(products, "HELD", held)
    one, asked, of = block(random.Random(5), 600, words, near=60), [], products.Dots.of
    monkeypatch.setattr(products.Dots, "of", lambda self, x, y: (asked.append(len(x)), of(self, x, y))[1])
    got = {(i, j): s for x, y, d in products.close_pairs(one, one, 0.6) for i, j, s in zip(x.tolist(), y.tolist(), d)}
    dots = whole(one)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(dots, 1) >= 0.6))}
    assert got.keys() == want and len(want) >= 60 and all(abs(got[p] - dots[p]) < 1e-12 for p in want)
    assert sum(asked) < len(want) + 0.02 * 600 * 599 / 2


def test_forest_joins_what_pairs_join(monkeypatch):
    one, other = block(random.Random(6), 400, 30, near=100), block(random.Random(6), 500, 30, near=0)
    for right in (one, other):
        every = [(int(i), int(j)) for x, y, _ in products.close_pairs(one, right, 0.6) for i, j in zip(x, y)]
        some = [(int(i), int(j)) for x, y, _ in products.close_pairs(one, right, 0.6, forest=True) for i, j in zip(x, y)]
        assert set(some) <= set(every) and every
        shift = 0 if right is one else len(one.ids)
        labels = [products._joined(np.arange(1000), np.array([i for i, _ in e]), np.array([j + shift for _, j in e])) for e in (every, some)]
        assert (labels[0] == labels[1]).all()


def test_alike_vectors_are_not_multiplied_pair_by_pair(monkeypatch):
    sets = [[*range(-60, 0), 1000 + k] for k in range(500)]
    one = products.Vectors(np.arange(500), np.arange(501) * 61, np.array(sum(sets, [])), np.full(500 * 61, 61**-0.5))
    asked, of = [], products.Dots.of
    monkeypatch.setattr(products.Dots, "of", lambda self, x, y: (asked.append(len(x)), of(self, x, y))[1])
    assert sum(len(x) for x, _, _ in products.close_pairs(one, one, 0.6, forest=True)) >= 499 and sum(asked) < 10 * 500


def test_blocks_of_one_length(monkeypatch):
    monkeypatch.setattr(products, "BLOCK_ENTRIES", 2_000_000)
    got = products.bands([(1, 10, 100), (2, 40_000, 200_000), (9, 100, 6_500_000), (30, 1, 5)], 1)
    assert got == {1: (0, 3), 2: (0, 3), 9: (3, 3), 30: (6, 1)}
    assert products.bands([], 1) == {}


@pytest.mark.parametrize("terms", [500_000, 1])
def test_weights_are_those_of_rows(spark, monkeypatch, terms):
    monkeypatch.setattr(similarity, "BROADCAST_TERMS", terms)
    rng = random.Random(8)
    words = [f"wort{k}" for k in range(40)] + ["Ünï", "x", "日本語"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(80)] + ["", None, ".", "Ünï Ünï", "Ünï Ünï"]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    bags = [Counter(re.findall(r"\w{2,}", (t or "").lower())) for t in texts]
    df = Counter(t for b in bags for t in b)
    raw = [{t: n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in b.items()} for b in bags]
    unit = [{t: w / math.sqrt(sum(v * v for v in r.values())) for t, w in r.items()} for r in raw]
    least = {t or "": k for k, t in reversed(list(enumerate(texts)))}
    dot = lambda a, b: sum(w * b.get(t, 0.0) for t, w in a.items())
    want = {(a, b): s for a in least.values() for b in least.values() if a < b and (s := dot(unit[a], unit[b])) >= 0.6}
    got = {(r.a, r.b): r.similarity for r in similarity.similar_representatives(items).collect()}
    assert got.keys() == want.keys() and want and all(abs(got[p] - want[p]) < 1e-9 for p in want)
