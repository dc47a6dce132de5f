"""Pairs from blocks against columns, the shape of the ranking's plan, and places of wanted items against all places."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import vectors
from weft.operators import blocks, retrieval
from weft.plans import language

VECTORS = [[1.0, 2.0], [0.0, 0.0], [0.1, -0.7], None, [1.0, None], [1.0], [], [3.0, float("nan")], [1e200, 1e200]]


def tables(spark, n=300):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, [rng.choice(words) for _ in range(rng.randrange(12))] if k % 9 else None, VECTORS[k % 9]) for k in range(n)]
    asked = [(q, " ".join(rng.choices(words, k=5)) if q else "", VECTORS[q % 9]) for q in range(20)]
    return spark.createDataFrame(asked, "qid long, text string, qvec array<double>"), spark.createDataFrame(rows, "id long, words array<string>, emb array<double>")


def test_pairs_are_those_of_columns(spark):
    q, rows = tables(spark)
    asked = retrieval._terms(q)
    size = vectors.norm(F.col("emb")) * vectors.norm(F.col("qvec"))
    alike = F.when(size == 0, 0.0).otherwise(vectors.dot(F.col("emb"), F.col("qvec")) / size)
    rel = F.coalesce(F.size(F.array_intersect(F.coalesce("words", F.array()), "terms")), F.lit(0)).cast("long")
    want = asked.join(rows, how="cross").select("qid", "id", rel.alias("rel"), alias_text(alike), (F.col("emb").isNotNull() & F.col("qvec").isNotNull()).alias("measured"))
    for few in (True, False):
        got = blocks.pairs(asked, rows, few, words=True, emb=True).select("qid", "id", "rel", alias_text(F.col("similarity")), "measured")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def alias_text(column):
    return column.cast("string").alias("similarity")


def test_hybrid_moves_pairs_once(spark):
    q, rows = tables(spark)
    chunks = rows.select(F.col("id").alias("chunk_id"), "id", F.array(F.lit(1.0), F.lit(2.0)).alias("emb"))
    plan = retrieval.hybrid(q, rows.withColumn("importance", F.col("id")), chunks, 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_texts_are_spread_over_tasks(spark, sf_small):
    assert language._searched(spark, sf_small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_places_of_wanted_items(spark):
    q, rows = tables(spark)
    wanted = spark.createDataFrame([(k, (k * 7 + j) % 310) for k in range(20) for j in (0, 11)], "qid long, id long")
    every = blocks.pairs(retrieval._terms(q), rows, True, words=True).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "id")))
    want = {tuple(r) for r in every.join(wanted, ["qid", "id"], "left_semi").select("qid", "id", "place").collect()}
    assert {tuple(r) for r in retrieval.places(q, rows, wanted).collect()} == want and want
