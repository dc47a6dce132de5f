"""Passages within texts, of any number of words, against plain search."""

from weft.plans import evaluation

TEXTS = ["one two three four", "xone twoy", "one\ntwo", "", None, " ", "three", "a one  two b", "four three two one", "zthreez end"]
PASSAGES = ["one two", "two three four", "three", "wo", " ", "e t", "one  two", None, "four", "nothing here at all", "\n"]


def test_passages_of_few_words(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(PASSAGES)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, evaluation.passages_contained(spark, str(tmp_path)).collect()))
    assert got == sorted((q, i) for q, p in enumerate(PASSAGES) for i, t in enumerate(TEXTS) if p is not None and t is not None and p in t)
