"""The suffix automaton against plain comparison of windows, several passes, cleaned texts, and the query against its SQL."""

import hashlib
import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.compare import same
from weft.llm import decontaminate as X
from weft.llm.automaton import SuffixAutomaton

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return [m.group() for m in WORD.finditer((text or "").encode().lower())]


def brute(text, items, window):
    words = split(text)
    hit, names, ends = set(), set(), set()
    for name, item in items:
        own = split(item)
        n = min(len(own), window)
        if not n:
            continue
        for s in range(len(words) - n + 1):
            if any(words[s : s + n] == own[k : k + n] for k in range(len(own) - n + 1)):
                hit |= set(range(s, s + n))
                ends.add(s + n)
                names.add("null" if name is None else str(name))
    owns = [b"\n" + b"\n".join(split(item)) + b"\n" for _, item in items]
    longest = max((max(k for k in range(1, min(e, 99) + 1) if any(b"\n" + b"\n".join(words[e - k : e]) + b"\n" in o for o in owns)) for e in ends), default=0)
    return len(words), sorted(hit), sorted(names), longest


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=12), max_size=4), st.lists(st.integers(0, 3), max_size=40))
def test_automaton(sequences, s):
    a = SuffixAutomaton(sequences)
    subs = {tuple(x[i:j]) for x in sequences for i in range(len(x)) for j in range(i, len(x) + 1)}
    state = matched = 0
    for k, number in enumerate(s, 1):
        state, matched = a.step(state, matched, number)
        assert matched == max(n for n in range(k + 1) if n == 0 or tuple(s[k - n : k]) in subs)
        assert matched <= a.length[state]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), min_size=1, max_size=4), st.lists(st.lists(st.sampled_from("abcdé"), max_size=30), max_size=4), st.integers(1, 5), st.randoms())
def test_texts_of_few_words(items, docs, window, rng):
    held = [(str(k), " ".join(w)) for k, w in enumerate(items)]
    texts = ["".join(rng.choice([w, w.upper() if w != "é" else w]) + rng.choice([" ", "\n", "--", "\x7f"]) for w in words) for words in docs]
    got = list(X.read_texts(X.Items([(i, split(t)) for i, t in held], window), [t.encode() for t in texts]))
    for text, (n, longest, spans, names, cleaned) in zip(texts, got, strict=True):
        want = brute(text, held, window)
        assert (n, [i for a, b in spans for i in range(a, b)], sorted(names), longest) == want
        words = split(text)
        assert split(cleaned.decode()) == [w for i, w in enumerate(words) if i not in want[1]]
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


RNG = random.Random(5)
PASSAGE = " ".join(RNG.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(40))
ITEMS = [(1, PASSAGE), (2, "Short one"), (10, PASSAGE.upper()), (3, None), (4, " .. "), (None, "alpha nothing else"), (5, "Üben é ü " * 5), (2, "twice named item"), (6, "one")]
TEXTS = [
    (1, "x " + PASSAGE + " y"), (2, "a short, ONE b"), (3, None), (4, ""), (5, "; ; "), (6, " ".join(PASSAGE.split()[:9])), (7, " ".join(PASSAGE.split()[:10])), (8, "twice named item"), (8, "twice named item"),
    (None, "alpha nothing else"), (9, "üben É ü üben é ü üben é ü üben é"), (10, "Üben é ü Üben é ü Üben é ü Üben é"), (11, "clean " * 300), (12, PASSAGE.replace(" ", "\x01-")),
    (13, "w " * 30_000 + PASSAGE + " w" * 30_000 + " " + "v" * 50_000), (14, " ".join(PASSAGE.split()[5:30]) + " zz " + " ".join(PASSAGE.split()[20:35])),
]


@pytest.mark.parametrize("pass_words", [X.PASS_WORDS, 30])
def test_rows(spark, pass_words):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in TEXTS], "doc_id long, text string, spans string, row int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, n_words int")
    got = X.contamination(docs, bench, pass_words=pass_words, with_text=True)
    assert got.columns == ["doc_id", "text", "row", "n_words", "longest", "spans", "items", "cleaned"]
    rows = got.collect()
    key = lambda r: (str(r[0]), str(r[1]))
    for r, (i, t) in zip(sorted(rows, key=key), sorted(TEXTS, key=key), strict=True):
        n, hit, names, longest = brute(t, ITEMS, 10)
        assert (r.doc_id, r.text, r.n_words, [k for s in r.spans for k in range(s.start, s.end)], r["items"], r.longest) == (i, t, n, hit, names, longest)
        assert [w for k, w in enumerate(split(t)) if k not in hit] == split(r.cleaned)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert X.contamination_digests(docs.limit(0), bench).collect() == []
    rows = X.contamination_digests(docs, bench.limit(0)).collect()
    assert len(rows) == len(TEXTS) and not any(r.contaminated or r.n_items for r in rows) and rows[0].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_decontaminate(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    got = {(r.doc_id, r.text) for r in X.decontaminate(docs, bench).collect()}
    assert (3, None) in got and (11, "clean " * 300) in got and (6, TEXTS[5][1]) in got
    assert not {1, 7, 12, 14} & {i for i, _ in got}  # hit words are the larger share
    assert next(t for i, t in got if i == 13) == "w " * 30_000 + " w" * 30_000 + " " + "v" * 50_000
    assert X.decontaminate(docs, bench, coverage=1.0).count() == len(TEXTS)


def test_sql(spark, sf_small, tmp_path):
    docs, bench = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    for k, (d, b) in enumerate([(docs, bench), (spark.read.parquet(f"{sf_small}/documents.parquet"), spark.read.parquet(f"{sf_small}/benchmark.parquet"))]):
        con = duckdb.connect()
        for name, df in (("documents", d), ("benchmark", b)):
            df.write.parquet(f"{tmp_path}/{name}{k}")
            con.sql(f"create view {name} as select * from '{tmp_path}/{name}{k}/*.parquet'")
        same(X.contamination_digests(d, b), con.sql(X.oracle()))
