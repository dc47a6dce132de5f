"""LM scoring: gradients, windows, word chances and the whole query against plain Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import attention as A
from weft.llm import lm as L


def test_gradients():
    rng = np.random.default_rng(0)
    m = A.Attention(7, 5, width=4, dtype=np.float64)
    m.p["d"] = rng.normal(0, 1, A.SPAN)
    x, y = rng.integers(0, 8, (3, 6)), rng.integers(-1, 5, (3, 6))
    _, g, ids, _ = m.loss(x, y)
    dense = np.zeros_like(m.p["e"])
    dense[ids] = g["e"]
    for name, p in m.p.items():
        for _ in range(8):
            at = tuple(rng.integers(0, s) for s in p.shape)
            old = p[at]
            p[at] = old + 1e-5
            up = m.loss(x, y)[0]
            p[at] = old - 1e-5
            down = m.loss(x, y)[0]
            p[at] = old
            assert (dense if name == "e" else g[name])[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_windows_score_each_position_once():
    rng = np.random.default_rng(1)
    m = A.Attention(9, 6, dtype=np.float64)
    m.p["d"] = rng.normal(0, 1, A.SPAN)
    sizes = np.array([1, 5, A.STRIDE, A.STRIDE + 1, 200, 31])
    ids, targets = rng.integers(0, 9, sizes.sum()), rng.integers(0, 6, sizes.sum())
    ids[np.r_[0, np.cumsum(sizes)[:-1]]] = 9
    got, at = A.score(m.tables(), ids, targets, sizes), 0
    for size, value in zip(sizes, got):
        x, y, want = ids[at : at + size], targets[at : at + size], 0.0
        at += size
        for t in range(size):
            first = max(0, t // A.STRIDE * A.STRIDE - A.BACK)
            want -= m.loss(x[None, first : t + 1], np.r_[np.full(t - first, -1), y[t]][None])[0]
        assert value == pytest.approx(want, rel=1e-4)


def test_a_step_keeps_its_arrays():
    import tracemalloc

    rng = np.random.default_rng(2)
    m, x, y = A.Attention(500, 17), rng.integers(0, 501, (A.BATCH, A.SPAN)), rng.integers(0, 17, (A.BATCH, A.SPAN))
    first = m.loss(x, y)
    tracemalloc.start()
    again = m.loss(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 900_000  # 2.3 MB before, when every step asked for new arrays
    m.loss(x[:5], np.where(x[:5] % 3 == 0, -1, y[:5]))  # rooms of another shape
    for other in (again, m.loss(x, y)):
        assert other[0] == first[0] and all((other[1][k] == g).all() for k, g in first[1].items()) and (other[2] == first[2]).all() and (other[3] == first[3]).all()


def test_learning_is_adagrad_over_all_windows():
    rng = np.random.default_rng(3)
    sizes = np.array([3, 900, A.SPAN * (2 * A.BATCH + 7), 1, A.SPAN])
    x, y = rng.integers(0, 40, sizes.sum()), rng.integers(0, 6, sizes.sum())
    m, plain = (A.Attention(40, 6, dtype=np.float64) for _ in range(2))
    met, windows = m.learn([(x[:903], y[:903], sizes[:2]), (x[903:], y[903:], sizes[2:])])
    xs, ys = [], []
    for end, size in zip(np.cumsum(sizes), sizes):
        pad = -size % A.SPAN
        xs.append(np.r_[x[end - size : end], np.zeros(pad, int)])
        ys.append(np.r_[y[end - size : end], np.full(pad, -1)])
    xs, ys = (np.concatenate(z).reshape(-1, A.SPAN) for z in (xs, ys))
    seen = np.bincount(ys[ys >= 0], minlength=6) + 1.0
    plain.p["c"] = np.log(seen / seen.sum())
    squares, times = {k: np.full(v.shape[:1] if k == "e" else v.shape, 1e-6) for k, v in plain.p.items()}, np.zeros(41, int)
    for at in range(0, len(xs), A.BATCH):
        _, g, ids, often = plain.loss(xs[at : at + A.BATCH], ys[at : at + A.BATCH])
        times[ids] += often
        for k in ("w", "u", "c", "d"):
            squares[k] += g[k] ** 2
            plain.p[k] -= A.RATE / 2 * g[k] / np.sqrt(squares[k])
        squares["e"][ids] += (g["e"] ** 2).mean(axis=1)
        plain.p["e"][ids] -= A.RATE * g["e"] / np.sqrt(squares["e"][ids])[:, None]
    assert windows == len(xs) and (met == times).all()
    assert all(m.p[k] == pytest.approx(v, abs=1e-9) for k, v in plain.p.items())


def plain_ids(word, pieces):
    """Longest pieces from the start, one by one."""
    rest, out = b" " + word, []
    while rest:
        piece = max((p for p in (rest[:k] for k in range(1, 40)) if p in pieces), key=len)
        out.append(pieces[piece])
        rest = rest[len(piece) :]
    return out


def test_ids_of_words(spark, sf_small):
    known, pieces = L.Segments(L.VOCABULARY_FILE), L.vocabulary(L.VOCABULARY_FILE)
    texts = [r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("text").limit(20).collect()] + ["", "\xff\x00 \u4e2d\u6587 a"]
    split = [L.tokens(t) for t in texts]
    words = [w for t in split for w in t]
    ids, sizes = known.of(known.numbers(words))
    want = [plain_ids(w, pieces) if w else [known.n - 1] for w in words]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    named = {}
    for w, n, x in zip(words, known.numbers(words).tolist(), want):
        named.setdefault(int(known.kinds[n]), set()).add(tuple(known.of_class[x].tolist()))
    assert all(len(x) == 1 for x in named.values()) and len(named) == len({next(iter(x)) for x in named.values()})


def test_words_are_looked_up_once(monkeypatch):
    import gc

    known, texts = L.Segments(L.VOCABULARY_FILE), ["a b a zebra b", "zebra \xff a c c", ""]
    words, passes, on = [w for t in texts for w in L.tokens(t)], [], gc.isenabled()
    real = np.fromiter
    monkeypatch.setattr(np, "fromiter", lambda *a: passes.append(len(a)) or real(*a))
    first = known.numbers(words).tolist()
    assert len(passes) == 2  # one over the words, one over the ids of new ones; before, words not yet known were looked up again
    assert known.numbers(words).tolist() == first and len(passes) == 3
    assert [list(known.number)[k] for k in first] == words and len(set(first)) == len(known.hashes) == len(known.number) == 6
    assert known.hashes[first].tolist() == [L.word_hash(w) for w in words]
    # no search for cycles while texts are split, and again afterwards
    seen = []
    monkeypatch.setattr(L, "tokens", lambda t, real=L.tokens: seen.append(gc.isenabled()) or real(t))
    L.sequences(known, texts)
    assert seen == [False] * 3 and gc.isenabled() == on


def softmax(v):
    e = np.exp(v - v.max())
    return e / e.sum()


def brute_score(text, model, known, pieces, counts):
    """Log10 probability of a text, id by id and word by word, from the model's parameters and the words' counts."""
    p, d = {k: v.astype(float) for k, v in model.p.items()}, A.WIDTH
    of_word = lambda w: plain_ids(w, pieces) if w else [known.n - 1]
    kind = lambda w: tuple(known.of_class[of_word(w)].tolist())
    ids = [i for w in L.tokens(text) for i in of_word(w)]
    x, total = [known.n, *ids[:-1]], 0.0
    for t, y in enumerate(ids):
        seen = x[max(0, t // A.STRIDE * A.STRIDE - A.BACK) : t + 1]
        q, k, v, r = np.split(p["e"][seen] @ p["w"], 4, axis=1)
        a = softmax(k @ q[-1] / math.sqrt(d) + p["d"][np.arange(len(seen))[::-1]])
        total += math.log10(softmax((a @ v + r[-1]) @ p["u"] + p["c"])[known.of_class[y]])
    for w in L.tokens(text)[:-1]:
        mates = {m: c for m, c in counts.items() if m and kind(m) == kind(w)}
        n = sum(mates.values())
        total += math.log10((counts[w] - L.DISCOUNT) / n if counts[w] else L.DISCOUNT * len(mates) / n if mates else 1.0)
    return total


@pytest.mark.parametrize("frequent", [L.FREQUENT, 20])
def test_whole_score_by_brute_force(spark, sf_small, monkeypatch, frequent):
    monkeypatch.setattr(L, "FREQUENT", frequent)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").where("n_chars < 250").limit(24)
    docs = docs.union(spark.createDataFrame([(9001, None), (9002, "Zażółć gęślą"), (9002, "Zażółć gęślą")], docs.schema)).repartition(3).cache()
    kept, real = [], L.learned
    monkeypatch.setattr(L, "learned", lambda *a: kept.append(real(*a)) or kept[0])
    got = {r.doc_id: r.score for r in L.score_documents(docs).collect()}
    known, pieces, model = L.Segments(L.VOCABULARY_FILE), L.vocabulary(L.VOCABULARY_FILE), kept[0][1]
    counts = Counter(w for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 1 for w in L.tokens(r.text or ""))
    for r in docs.collect():
        assert got[r.doc_id] == pytest.approx(brute_score(r.text or "", model, known, pieces, counts), rel=1e-4)


def test_what_is_learned_covers_every_text(spark):
    texts = [f"w{i} " * 40 + "late" * 3 + str(i) for i in range(40)]
    counts, model = L.learned(spark.createDataFrame([(t,) for t in texts], "text string").withColumn("k", F.xxhash64("text")).repartition(4), L.VOCABULARY_FILE)
    want = Counter(L.word_hash(w) for t in texts for w in L.tokens(t))
    assert {r.h: r.c for r in counts.collect()} == want
    known = L.Segments(L.VOCABULARY_FILE)
    fresh = A.Attention(known.n, L.CLASSES + 1)
    moved = set(np.flatnonzero((model.p["e"] != fresh.p["e"]).any(axis=1)).tolist())
    assert {i for t in texts for i in L.sequences(known, [t]).inputs.tolist()} <= moved


def test_chances_of_a_sequence_of_classes_sum_to_one():
    c, n, v = np.array([5, 1, 1, 0, 0]), np.array([7, 7, 7, 7, 0]), np.array([3, 3, 3, 3, 0])
    held = 10.0 ** L.within(c, n, v)
    assert held[:4].sum() == pytest.approx(1) and held[4] == 1


def brute(rows):
    held = lambda i: zlib.crc32(str("null" if i is None else i).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in L.tokens(t or ""))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        ws = L.tokens(t or "")
        out.append((i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)))
    return out


@pytest.mark.parametrize("frequent", [L.FREQUENT, 50])
def test_counts_and_base_on_the_table(spark, sf_small, monkeypatch, frequent):
    monkeypatch.setattr(L, "FREQUENT", frequent)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "a null id"), (9001, None), (9002, ""), (9003, "Éa \x0bZ z"), (9004, "same words"), (9004, "same words"), (9004, "other words"), (9005, "w " * 40000)], "doc_id long, text string")
    docs = docs.union(odd).withColumn("k", F.lit(1)).withColumn("h", F.lit(1)).withColumn("kind", F.lit(1))
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=lambda r: (str(r[0]), r[2], r[5]))
    got = sorted(L.score_documents(docs).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert tuple(g)[:5] == w[:5] and g.base_score == pytest.approx(w[5], rel=1e-9)
        assert math.isfinite(g.score) and g.score < 0
    held = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 9000]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def test_empty_table(spark):
    assert L.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_scores_do_not_depend_on_partitions(spark, sf_small, monkeypatch):
    monkeypatch.setattr(L, "SHARD_TEXTS", 60)  # several shards
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    runs = [{r.doc_id: r for r in L.score_documents(docs.repartition(n)).collect()} for n in (1, 4, 7)]
    assert runs[0].keys() == runs[1].keys() == runs[2].keys()
    for other in runs[1:]:
        for i, r in runs[0].items():
            assert (r.n_tokens, r.n_known) == (other[i].n_tokens, other[i].n_known)
            assert abs(r.score - other[i].score) < 1e-3 + 1e-6 * abs(r.score) and abs(r.base_score - other[i].base_score) < 1e-6 * abs(r.base_score) + 1e-9
