"""Operators on small tables: selection, context, lifecycle, evaluation."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weft import vocab
from weft.operators import catalog, digest, evaluate, graph, ingest, lifecycle, retrieval, similarity

NOW = datetime(2026, 7, 20)
ITEM = "id long, roles array<string>, impact_label string, score double, tier string, trust_score double, published_at timestamp_ntz, created_at timestamp_ntz, status string, is_primary boolean, recommendations map<string, struct<action_type: string, note: string, urgency: string>>, indicators map<string, boolean>"


def item(i, roles, urgency="medium", impact="Cao", score=0.5):
    return (i, roles, impact, score, "Tactical", 0.5, NOW, NOW, "published", True, {r: ("read", "n", urgency) for r in roles}, {})


def selected(spark, people, items, log=()):
    subs = spark.createDataFrame(people, "subscriber long, roles array<string>, active boolean")
    sent = spark.createDataFrame(list(log), "subscriber long, id long, kind string, sent_at timestamp_ntz")
    return digest.select(subs, spark.createDataFrame(items, ITEM), sent).orderBy("subscriber", "place").collect()


def test_digest_caps_and_overflow(spark):
    out = selected(spark, [(1, ["Dev"], True)], [item(i, ["Dev"]) for i in range(9)])
    assert [r.id for r in out] == [0, 1] and {r.overflow for r in out} == {7}
    roles = ["Dev", "Security", "AI Engineer"]
    out = selected(spark, [(1, roles, True)], [item(3 * k + j, [r]) for k, r in enumerate(roles) for j in range(3)])
    assert len(out) == 3


def test_digest_owner_wildcard_and_sent(spark):
    items = [item(1, ["Dev", "Security"], "low"), item(2, [vocab.COMPANY_WIDE]), item(3, ["Dev"], "high"), item(4, ["Dev"])]
    items[0][10]["Security"] = ("read", "n", "high")
    out = selected(spark, [(1, ["Dev", "Security"], True), (2, ["Data Analyst"], True), (3, ["Dev"], False), (4, [], True)], items, [(1, 3, "brief", NOW), (1, 4, "welcome", NOW)])
    assert [(r.subscriber, r.id, r.role) for r in out if r.subscriber == 2] == [(2, 2, vocab.COMPANY_WIDE)]
    mine = {r.id: r.role for r in out if r.subscriber == 1}
    assert mine == {1: "Security", 2: vocab.COMPANY_WIDE, 4: "Dev"} and {r.subscriber for r in out} == {1, 2}


def test_pins_are_layered(spark):
    history = spark.createDataFrame([(1, 1, [10, 11, 12, 13, 14]), (1, 2, [20, None]), (1, 3, [None])], "conv_id long, turn long, citations array<long>")
    assert [r.id for r in retrieval.pins(history, 3).orderBy("place").collect()] == [20, 10, 11]


PLACED = "qid long, id long, place int"


def numbered(spark, ranked, refs=(), pinned=(), best=None, web=None, **limits):
    made = lambda ids: spark.createDataFrame([(1, i, k) for k, i in enumerate(ids)], PLACED)
    best = None if best is None else spark.createDataFrame([(1, best)], "qid long, id long")
    web = None if web is None else spark.createDataFrame([(1, k, u) for k, u in enumerate(web)], "qid long, place int, uri string")
    ranked = spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(ranked)], PLACED)
    return retrieval.context(ranked, made(refs), made(pinned), best, web, **limits).orderBy("n").collect()


def test_context_pins_displace_the_tail(spark):
    out = numbered(spark, range(1, 9), [5], [99, 5, 2], k_deep=2, index_limit=5)
    assert [(r.n, r.id, r.depth) for r in out] == [(1, 5, "deep"), (2, 1, "deep"), (3, 2, "index"), (4, 3, "index"), (5, 99, "index")]
    # what the index shows already keeps its number
    assert [r.id for r in numbered(spark, range(1, 11), pinned=[4], k_deep=3, index_limit=5)] == [1, 2, 3, 4, 5]
    assert [r.id for r in numbered(spark, range(1, 11), pinned=[4, 9], k_deep=3, index_limit=5)] == [1, 2, 3, 4, 9]


def test_context_slots(spark):
    ids = lambda *a, **k: [(r.id, r.depth) for r in numbered(spark, *a, **k)]
    assert ids(range(1, 9), [3], best=7, k_deep=3, index_limit=5) == [(3, "deep"), (7, "deep"), (1, "deep"), (2, "index"), (4, "index")]
    assert ids(range(1, 9), best=77, k_deep=2, index_limit=3) == [(1, "deep"), (2, "deep"), (3, "index")]
    assert ids(range(1, 9), [8, 6, 5, 4], best=3, k_deep=3, index_limit=5) == [(8, "deep"), (6, "deep"), (5, "deep"), (1, "index"), (2, "index")]
    assert ids(range(1, 9), [8, 6], k_deep=3, index_limit=1) == [(8, "deep")]
    out = numbered(spark, [1, 2], web=["u", "v"], k_deep=1, index_limit=2)
    assert [(r.n, r.id, r.depth, r.uri) for r in out] == [(1, 1, "deep", None), (2, 2, "index", None), (3, None, "web", "u"), (4, None, "web", "v")]


def test_markers_out_of_range_and_spaces(spark):
    from weft.functions import text

    df = spark.createDataFrame([("a [99999999999] b [01] [2]\t.",), ("Yes [9]\t.",), ("x  [3]   y\n",)], "answer string")
    got = df.selectExpr("*", "array(1) as m").select(text.markers(df.answer), text.without_unmapped(df.answer, F.col("m"))).collect()
    assert [tuple(r) for r in got] == [([1, 2], "a b [01]."), ([9], "Yes."), ([3], "x y")]


def fused(spark, qvec=(1.0, 0.0), question="rust news", chunks=()):
    q = spark.createDataFrame([(1, question, list(qvec) if qvec else None)], "qid long, text string, qvec array<float>")
    items = spark.createDataFrame([(1, ["rust"], [0.0, 1.0], 0.1), (2, ["go"], [1.0, 0.0], 0.9), (3, ["rust"], None, 0.5)], "id long, words array<string>, emb array<float>, importance double")
    c = spark.createDataFrame(list(chunks), "chunk_id long, id long, emb array<float>")
    return [r.id for r in retrieval.hybrid(q, items, c).orderBy("place").collect()]


def test_hybrid_degrades_by_rule(spark):
    assert fused(spark) == [3, 1, 2]
    assert fused(spark, qvec=None) == [3, 1, 2]
    assert fused(spark, question="là gì") == [2, 3, 1]
    assert fused(spark, chunks=[(1, None, [1.0, 0.0])]) == fused(spark)
    assert fused(spark, chunks=[(1, 2, [1.0, 0.0])]) == [3, 2, 1]


def test_clusters_with_copies(spark):
    texts = ["the quick brown fox jumps"] * 4 + ["the quick brown fox jumps high", "quite other words here now", "", "", "lone"]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = {r.id: r.cluster for r in similarity.clusters(items).collect()}
    assert {out[i] for i in range(5)} == {0} and out[5] == 5 and out[6] == out[7] == 6 and out[8] == 8


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    out = {r.node: r.label for r in graph.components(edges).collect()}
    assert {out[i] for i in range(41)} == {0} and out[101] == 100
    assert graph.components(edges.limit(0)).count() == 0


def test_upsert_and_queue(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, name string, v double")
    new = spark.createDataFrame([(2, "B", None), (3, "c", 3.0)], old.schema)
    assert sorted(tuple(r) for r in lifecycle.upsert(old, new, "id").collect()) == [(1, "a", 1.0), (2, "B", 2.0), (3, "c", 3.0)]
    docs = spark.createDataFrame([(i, "pending", NOW if i else None) for i in range(5)], "id long, status string, published_at timestamp_ntz")
    assert [r.id for r in ingest.work_queue(docs, 3, 98, 100).collect()] == [1, 2] and ingest.work_queue(docs, 3, 200, 100).count() == 0


def test_evaluation(spark):
    rows = spark.createDataFrame([(True, True)] * 34 + [(False, True)] * 3 + [(False, False)] * 17, "label boolean, predicted boolean")
    r = evaluate.confusion(rows).first()
    assert (r.tp, r.fp, r.fn, r.tn, round(r.accuracy, 2), round(r.precision, 2), r.recall, round(r.f1, 2)) == (34, 3, 0, 17, 0.94, 0.92, 1.0, 0.96)
    assert evaluate.confusion(rows.limit(0)).first().f1 == 0.0
    answers = spark.createDataFrame([(1, "a [1] [2]", [1]), (2, "none", [1])], "aid long, answer string, served array<int>")
    assert {r.aid: r.precision for r in evaluate.citation_precision(answers).collect()} == {1: 0.5, 2: 1.0}
    scores = spark.createDataFrame([(0.96, 1.0, 0.9), (0.98, 1.0, 0.9)], "faithfulness double, precision double, relevance double")
    assert evaluate.quality_gate(scores, 0.94).first().passed and not evaluate.quality_gate(scores, 0.96).first().passed
    assert ingest.first_of_each(spark.createDataFrame([("k", 2), ("k", 1)], "k string, o int"), "k", "o").first().o == 1
    assert evaluate.newest_first(spark.createDataFrame([("k", 2), ("k", 1)], "k string, o int"), "k", "o").first().o == 2


def test_references_by_count_and_by_page(spark):
    rows = [(1, 7, "published"), (2, 7, "published"), (3, 7, "pending"), (4, 7, None), (5, 8, "published"), (6, None, "published")]
    items = spark.createDataFrame(rows, "id long, cluster_id long, status string")
    counts = {r.id: (r.cluster_id, r.n_others) for r in catalog.references(items).collect()}
    assert counts == {1: (7, 1), 2: (7, 1), 3: (7, 2), 4: (7, 2), 5: (8, 0)}
    asked = spark.createDataFrame([(i,) for i in (1, 3, 3, 5, 6, 99, None)], "id long")
    pairs = catalog.references_of(items, asked).collect()
    assert sorted(map(tuple, pairs)) == [(1, 2), (3, 1), (3, 2)]
    every = catalog.references_of(items, items.select("id")).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in every} == {i: n for i, (_, n) in counts.items() if n}
    assert catalog.references(items.limit(0)).isEmpty() and catalog.references_of(items.limit(0), asked).isEmpty()


@pytest.mark.parametrize("held", [7, 200_000])
def test_components_of_chains_stars_and_texts(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "HELD", held)
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(100, 400)] + [(1000, 1000 + k) for k in range(1, 60)] + [(2000 + k % 7, 2000 + (k * 3) % 7) for k in range(30)] + [(5, 5), (None, 7), (8, None)]
    rng.shuffle(links)
    want = {5: 5} | {k: 100 for k in range(100, 401)} | {1000 + k: 1000 for k in range(60)}
    for made in (lambda x: x, lambda x: None if x is None else f"{x:06}", lambda x: None if x is None else f"{x:06}".encode()):
        edges = spark.createDataFrame([(made(a), made(b)) for a, b in links], f"a {(k := {int: 'long', str: 'string', bytes: 'binary'}[type(made(1))])}, b {k}").repartition(5)
        got = {r.node if not isinstance(r.node, bytearray) else bytes(r.node): r.label if not isinstance(r.label, bytearray) else bytes(r.label) for r in graph.components(edges).collect()}
        assert {k: v for k, v in got.items() if not (made(2000) <= k < made(2007))} == {made(k): made(v) for k, v in want.items()}
