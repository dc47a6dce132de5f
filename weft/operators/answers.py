"""Answers over batches of questions with injected model outputs, and backfills of vectors and passages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import rendering, text
from weft.operators import chunks

INSUFFICIENT = "Không đủ căn cứ để trả lời câu hỏi này."


def mode(requests: DataFrame) -> DataFrame:
    """requests (refs array, item_id) with mode: focused with references, insight with an item, else global; expanded where an insight answer was the sentinel."""
    base = F.when(F.size(F.coalesce("refs", F.array().cast("array<bigint>"))) > 0, "focused").when(F.col("item_id").isNotNull(), "insight").otherwise("global")
    return requests.withColumn("mode", base)


def resolved(answers: DataFrame, mapping: DataFrame, sentinel: str, message: str = INSUFFICIENT) -> DataFrame:
    """(aid, answer, n_citations, outcome) of model answers (aid, answer) over a mapping (aid, n, id).

    Markers without a source are taken out. outcome: out_of_scope for the sentinel alone, grounded with citations,
    not_found where the answer says so, else insufficient with a fixed message.
    """
    served = mapping.groupBy("aid").agg(F.collect_set("n").alias("served"))
    rows = answers.join(served, "aid", "left").withColumn("served", F.coalesce("served", F.array().cast("array<int>")))
    clean = rows.select("aid", "answer", text.without_unmapped(F.col("answer"), F.col("served")).alias("clean"), F.size(F.array_intersect(text.markers(F.col("answer")), F.col("served"))).alias("n_citations"))
    outcome = F.when(rendering.is_sentinel(F.col("answer"), sentinel), "out_of_scope").when(F.col("n_citations") > 0, "grounded").when(text.says_not_found(F.col("answer")), "not_found").otherwise("insufficient")
    marked = clean.withColumn("outcome", outcome)
    return marked.select("aid", F.when(F.col("outcome") == "insufficient", F.lit(message)).otherwise(F.col("clean")).alias("answer"), "n_citations", "outcome")


def with_web(answers: DataFrame, web: DataFrame) -> DataFrame:
    """(aid, answer, source): the web turn's answer where one was asked for and came back; else the first, its request taken out."""
    asked = answers.select("aid", "answer", rendering.web_query(F.col("answer")).alias("query")).join(web.select("aid", F.col("answer").alias("web_answer")), "aid", "left")
    use = F.col("query").isNotNull() & (F.coalesce("web_answer", F.lit("")) != "")
    return asked.select("aid", F.when(use, F.col("web_answer")).otherwise(rendering.without_web_query(F.col("answer"))).alias("answer"), F.when(use, "web").otherwise("corpus").alias("source"))


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], size: int = 32) -> DataFrame:
    """rows (id, text) to (id, emb): embed is called on size texts at a time; a call that fails or returns another number of vectors leaves nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[list[float] | None] = []
            for at in range(0, len(batch), size):
                texts = batch["text"].iloc[at : at + size].tolist()
                try:
                    got = embed(texts)
                except Exception:  # noqa: BLE001  the model is foreign code
                    got = []
                out += got if len(got) == len(texts) else [None] * len(texts)
            yield pd.DataFrame({"id": batch["id"], "emb": out})

    return rows.select("id", "text").mapInPandas(run, "id long, emb array<float>")


def lacking(items: DataFrame, done: DataFrame, redo: bool = False, limit: int | None = None) -> DataFrame:
    """Items (id, ...) to work on: those without rows in done (id), or all again; the newest ids of at most limit."""
    out = items if redo else items.join(done.select("id").distinct(), "id", "left_anti")
    return out if limit is None else out.orderBy(F.desc("id")).limit(limit)


def passages_backfilled(items: DataFrame, existing: DataFrame, redo: bool = False) -> DataFrame:
    """Passages (id, ordinal, content) after a backfill of items (id, text)."""
    fresh = chunks.chunked(lacking(items, existing, redo))
    return existing.join(fresh.select("id").distinct(), "id", "left_anti").unionByName(fresh) if redo else existing.unionByName(fresh)


def acceptance(events: DataFrame) -> DataFrame:
    """(request, hard, soft): no id leaks, one commit or error and it comes last; a status comes before the first token. events (request, seq, kind, payload)."""
    uuid = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("seq")))
    final = F.col("kind").isin("commit", "error")
    seen = events.groupBy("request").agg(
        F.count_if(final).alias("finals"), F.max(F.when(final, F.col("seq"))).alias("final"), F.max("seq").alias("last"),
        F.count_if(F.col("payload").rlike(uuid)).alias("leaks"), first("status").alias("status"), first("token").alias("token"),
    )
    hard = (F.col("finals") == 1) & (F.col("final") == F.col("last")) & (F.col("leaks") == 0)
    return seen.select("request", F.coalesce(hard, F.lit(False)).alias("hard"), F.coalesce(F.col("token").isNull() | (F.col("status") < F.col("token")), F.lit(False)).alias("soft"))


def sentinel_rate(answers: DataFrame, sentinel: str) -> DataFrame:
    """One row: share of answerable questions (answerable) whose answer is the sentinel."""
    return answers.where("answerable").agg(F.round(F.avg(rendering.is_sentinel(F.col("answer"), sentinel).cast("int")), 6).alias("false_positive_rate"))


def integrity(scenarios: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, problem) of evaluation scenarios (id, mode, must_have, anchor, cited); an empty result is a sound set."""
    twice = scenarios.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("problem"))
    modes = scenarios.where(~F.col("mode").isin("insight", "global", "expanded", "focused")).select("id", F.lit("unknown mode").alias("problem"))
    labels = scenarios.select("id", F.explode("must_have").alias("item")).join(corpus.select(F.col("id").alias("item")), "item", "left_anti").select("id", F.lit("label outside the corpus").alias("problem"))
    anchored = F.col("mode").isin("insight", "expanded")
    anchors = scenarios.where(anchored & F.col("anchor").isNull() | ~anchored & F.col("anchor").isNotNull()).select("id", F.lit("anchor and mode disagree").alias("problem"))
    overlap = scenarios.where(F.arrays_overlap("must_have", "cited")).select("id", F.lit("label already cited").alias("problem"))
    return twice.union(modes).union(labels).union(anchors).union(overlap).distinct()
