"""Raking against plain Python, and the query against its SQL."""

import hashlib

import duckdb
import pytest

from weft.llm import mixing as X


def brute(rows, topics):
    known = [(i, s or X.NONE, l or X.NONE, topics.get(i, X.NONE), len((t or "").split())) for i, t, l, s in rows]
    cells = {}
    for _, s, l, t, n in known:
        if n:
            cells[s, l, t] = cells.get((s, l, t), 0) + n
    weight, goals = dict(cells), []
    for d, dim in enumerate(X.DIMS):
        margin = {}
        for c, n in cells.items():
            margin[c[d]] = margin.get(c[d], 0) + n
        powers = {k: v ** X.TEMPER[dim] for k, v in margin.items()}
        goals.append({k: p / sum(powers.values()) for k, p in powers.items()})
    for _ in range(X.ROUNDS):
        for d in range(3):
            held = {}
            for c, w in weight.items():
                held[c[d]] = held.get(c[d], 0) + w
            weight = {c: w * goals[d][c[d]] / held[c[d]] for c, w in weight.items()}
    tilt = {c: weight[c] / sum(weight.values()) / (cells[c] / sum(cells.values())) for c in cells}
    out = []
    for i, s, l, t, n in known:
        rate = tilt[s, l, t] / max(tilt.values()) if (s, l, t) in tilt else 1.0
        u = int(hashlib.md5(f"{X.SEED}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13
        out.append((i, round(rate, 5), u < rate))
    return sorted(out, key=str), weight, goals


def test_small_tables(spark):
    rows = [(i, "w " * (i % 7), "en" if i % 3 else "de", f"s{i % 4}") for i in range(60)]
    rows += [(None, "no id", None, None), (61, None, "fr", "s9"), (62, "", None, "s0"), (5, "again and again", "en", "s1"), (5, "again and again", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as topic", "2 as weight")
    topics = spark.createDataFrame([(i, str(i % 2)) for i in range(30)] + [(3, "1"), (None, "0")], "doc_id long, topic string")
    got = X.mix(docs, topics).collect()
    want, weight, goals = brute(rows, {i: str(i % 2) for i in range(30)})
    assert sorted(((r.doc_id, round(r.probability, 5), r.selected) for r in got), key=str) == want
    share = sum(w for c, w in weight.items() if c[1] == "de") / sum(weight.values())
    assert abs(share - goals[1]["de"]) < 1e-3
    assert X.mix(docs.limit(0), topics).count() == 0


def test_matches_sql(spark, sf_small):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_small}/{t}.parquet'")
    want = sorted(con.sql(X.oracle()).fetchall())
    docs, emb = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "embeddings"))
    got = sorted(tuple(r) for r in X.mix(docs, X.topics_of(emb)).collect())
    assert len(got) == len(want) == 200
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[7] == w[7] and g[5:7] == pytest.approx(w[5:7], abs=2e-6)


def test_target_shares_from_outside(spark):
    rows = [(i, "word " * (1 + i % 9), "en" if i % 4 else "de" if i % 8 else "fr", f"s{i % 3}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    wanted = {"lang": {"de": 0.6, "xx": 0.1}, "source": {"s0": 0.5, "s1": 0.5, "s2": 0.0}}
    got = X.mix(docs, wanted=wanted, rounds=40).collect()
    mass = {}
    for r in got:
        mass[r.lang] = mass.get(r.lang, 0) + r.n_tokens * r.probability
    total = sum(mass.values())
    assert mass["de"] / total == pytest.approx(0.6 / 0.9, abs=1e-3)  # nothing is of language xx
    tokens = {x: sum(len(t.split()) for _, t, lang, _ in rows if lang == x) ** X.TEMPER["lang"] for x in ("en", "fr")}
    assert mass["en"] / total == pytest.approx(0.3 / 0.9 * tokens["en"] / sum(tokens.values()), abs=1e-3)
    of = {s: sum(r.n_tokens * r.probability for r in got if r.source == s) / total for s in ("s0", "s1", "s2")}
    assert of["s0"] == pytest.approx(0.5, abs=1e-3) and of["s2"] == 0 and not any(r.selected for r in got if r.source == "s2")
    with pytest.raises(ValueError, match="lang"):
        X.mix(docs, wanted={"lang": {"de": 0.8, "en": 0.3}})
