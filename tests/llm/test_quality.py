"""The perplexity model against dictionaries in plain Python, and the classifier on labelled documents."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from weft.llm import quality as Q


def brute(train, texts):
    counts = collections.Counter(w for t in train for w in Q.TOKENS.findall(t))
    chosen = sorted((w for w, n in counts.items() if n >= Q.LEAST_COUNT), key=lambda w: (-counts[w], w))[: Q.VOCABULARY]
    vocab = {*chosen, *Q.SHAPES}
    words = lambda t: ["<s>", "<s>", *[w if w in vocab else Q.shape(w) for w in Q.TOKENS.findall(t)], "</s>"]
    three = collections.Counter(g for t in train for x in [words(t)] for g in zip(x, x[1:], x[2:]))
    two = collections.Counter(g[1:] for g in three)
    one = collections.Counter(g[1:] for g in two)
    ds = [Q.discounts(collections.Counter(c.values())) for c in (three, two, one)]
    cut = lambda d, n: d[min(n, 3) - 1] if n else 0.0

    def p(level, gram):
        c, d = (three, two, one)[level], ds[level]
        context = {k: n for k, n in c.items() if k[:-1] == gram[:-1]}
        lower = 1 / len(vocab) if level == 2 else p(level + 1, gram[1:])
        if not context:
            return lower
        return (c[gram] - cut(d, c[gram]) + sum(cut(d, n) for n in context.values()) * lower) / sum(context.values())

    out = []
    for t in texts:
        x = words(t or "")
        out.append((sum(math.log(p(0, g)) for g in zip(x, x[1:], x[2:])), len(x) - 2))
    return out


def test_probabilities_match_dictionaries(spark):
    train = ["The cat sat on the mat. The dog sat.", "a b a b a c A-1 the cat sat on a mat", "The dog sat on the cat, the cat sat!"] * 2
    texts = ["The cat sat.", None, "", "zebra ZEBRA 77 !! the the", "The cat sat on the mat. The dog sat.", "x" * 5000]
    model, three = Q.train(spark.createDataFrame([(t,) for t in train], "text string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as k", "2 as n", "3 as shard")
    rows = docs.select("doc_id", Q.row_key("doc_id", "text").alias("key")).join(Q.perplexities(docs, model, three).withColumnRenamed("k", "key"), "key").collect()
    got = {r.doc_id: (r.log_p, r.n) for r in rows}
    for i, want in enumerate(brute(train, texts)):
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_labelled_documents(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    out = Q.classify(docs, labels).cache()
    assert out.count() == docs.count()
    rates = {r.quality: r.a for r in out.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("accepted").cast("int")).alias("a")).collect()}
    assert rates[1] > 0.98 and rates[0] < 0.2
    kept = Q.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == out.where("accepted").count()


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, k int, n int"
    rows = [(i, f"some words of text number {i % 5}", "en", 1, 1) for i in range(30)] + [(None, None, None, 1, 1), (40, "", "fr", 1, 1), (5, "some words of text number 0", "en", 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = Q.classify(docs, labels)
    assert out.count() == len(rows) and out.where("accepted is null").count() == 0
    assert Q.classify(docs, labels.limit(0)).where("accepted").count() == len(rows)
    assert Q.classify(docs.limit(0), labels).count() == 0 and Q.accepted(docs.limit(0), labels).count() == 0


def test_every_trusted_document_counts(spark, monkeypatch):
    labels = spark.range(5000).selectExpr("id as doc_id", "1 as quality")
    learn, judge = Q.split_trusted(labels)
    assert learn.count() > 2000 and learn.count() + judge.count() == 5000 and learn.join(judge, "doc_id").count() == 0
    # shards and their rows grow with the counts; probabilities stay the same
    train = [f"the cat number {k % 7} sat on the mat {k % 5} and so did dog {k % 3}" for k in range(60)]
    docs = spark.createDataFrame(list(enumerate([*train[:20], "zebra", "", None])), "doc_id long, text string")
    model, three = Q.train(spark.createDataFrame([(t,) for t in train], "text string"))
    want = {r.k: (r.log_p, r.n) for r in Q.perplexities(docs, model, three).collect()}
    monkeypatch.setattr(Q, "SHARD_WORDS", 20)
    monkeypatch.setattr(Q, "HELD", 3)
    model, three = Q.train(spark.createDataFrame([(t,) for t in train], "text string"))
    assert model.shards > Q.SHARDS
    got = {r.k: (r.log_p, r.n) for r in Q.perplexities(docs, model, three).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_copies_of_the_counts_follow_the_training_words(spark):
    train = [f"the cat number {k % 7} sat on the mat {k % 5} and so did dog {k % 3}" for k in range(60)]
    model, _ = Q.train(spark.createDataFrame([(t,) for t in train], "text string"))
    # by this number copies are bounded: one number of the vocabulary's words, whatever the loops after it count
    assert model.words == sum(n for n in collections.Counter(w for t in train for w in Q.TOKENS.findall(t)).values() if n >= Q.LEAST_COUNT) == 60 * 14
