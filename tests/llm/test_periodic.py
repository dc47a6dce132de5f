"""Runs against plain comparison of all periods, whole texts, and the query against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.compare import same
from weft.llm import periodic as X


def brute(s, least, times):
    """Every period tried at every place."""
    found = {}
    n = len(s)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((a, length, q) for (a, length), q in found.items())


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([(2, 2), (4, 2), (6, 3), (3, 3), (24, 3), (8, 4)]))
def test_runs_of_few_letters(s, kind):
    assert X.runs(s, *kind) == brute(s, *kind)


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_repetitive_sequences(seed):
    rng = random.Random(seed)
    s = []
    while len(s) < 600:  # copies of copies, with runs inside and across them
        kind = rng.random()
        if kind < 0.4 and s:
            a = rng.randrange(len(s))
            s += s[a : a + rng.randrange(1, 120)]
        elif kind < 0.8:
            s += [rng.randrange(rng.choice([1, 2, 30])) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 12)
        else:
            s += [rng.randrange(1000) for _ in range(rng.randrange(30))]
    for kind in ((24, 3), (2, 2), (10, 2)):
        assert X.runs(s, *kind) == brute(s, *kind)


def test_gram_width():
    for least, times in ((24, 3), (2, 2), (10, 4), (1, 3)):
        w = X.gram_width(least, times)
        assert all(max(least, times * q) - w + 1 >= 2 * q or w == 1 for q in range(1, 200))
    assert X.gram_width(24, 3) == 9


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["a", "b", "cc", "ä", "B"]), max_size=70), st.integers(0, 2**32 - 1) | st.none()), max_size=4), st.randoms())
def test_texts(docs, rng):
    texts = ["".join(w + rng.choice([" ", "\n", "\t \x0b"]) for w in words).encode() for words, _ in docs]
    draws = [None if d is None else d - d % 10 for _, d in docs]
    for (words, _), draw, (runs, text) in zip(docs, draws, X.text_runs(texts, draws, 24, 3), strict=True):
        assert (runs, text.decode()) == plain(words, draw)


def plain(words, draw):
    n = len(words)
    if draw is not None and draw % 10 == 0 and n:
        g = draw // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute(words, 24, 3), key=lambda r: (r[0], r[2]))
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


PERIODIC = "lead in " + "one two three " * 20 + "then " + "x " * 30 + "one two three " * 9 + "end"
ROWS = [(i, t) for i, t in enumerate([PERIODIC, None, "", " \n", "a", "word " * 50, " ".join(f"w{i % 37}" for i in range(400)), "É É " * 30, "a b " * 11 + "a"])]
ROWS += [(i, " ".join(f"w{k * k % 91}" for k in range(i))) for i in range(20, 140)] + [(None, PERIODIC), (3, PERIODIC), (3, PERIODIC), (-5, PERIODIC)]
ROWS += [(10**6, " ".join(f"w{k}" for k in range(60_000)) + " again and again" * 2000)]


def test_digests(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, runs string, `start` int")
    got = sorted((tuple(r) for r in X.run_digests(docs).collect()), key=repr)
    want = []
    for i, t in ROWS:
        if i == 10**6:
            continue
        runs, text = plain((t or "").encode().decode().split(), None if i is None else zlib.crc32(str(i).encode()))
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert [g for g in got if g[0] != 10**6] == sorted(want, key=repr)
    assert next(g for g in got if g[0] == 10**6)[1] >= 1


def test_collapse_keeps_other_columns(spark):
    docs = spark.createDataFrame([(PERIODIC, 4, "r")], "text string, row int, `a.b` string")
    got = X.collapse(docs).collect()[0]
    assert got.text == PERIODIC and got.row == 4 and got["a.b"] == "r" and got.collapsed == "lead in one two three then x one two three end"
    assert [tuple(r) for r in got.runs] == [(2, 60, 3), (63, 30, 1), (93, 27, 3)]
    assert X.run_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sql(spark, sf_small, tmp_path):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_small}/documents.parquet'")
    same(X.run_digests(spark.read.parquet(f"{sf_small}/documents.parquet")), con.sql(X.oracle()))
    con = duckdb.connect()
    spark.createDataFrame(ROWS[:-1], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    same(X.run_digests(spark.createDataFrame(ROWS[:-1], "doc_id long, text string")), con.sql(X.oracle()))
