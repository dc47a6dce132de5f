"""Evaluation of gates, rankings and answers against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall and f1 of rows (label, predicted: booleans), by columns if given; 0 for empty divisors."""
    counts = rows.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in (("tp", F.col("label") & F.col("predicted")), ("fp", ~F.col("label") & F.col("predicted")), ("fn", F.col("label") & ~F.col("predicted")), ("tn", ~F.col("label") & ~F.col("predicted")))])
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    rates = counts.select("*", F.round(ratio(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"), F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, tp + fn), 6).alias("recall"))
    return rates.withColumn("f1", F.round(ratio(2 * tp, 2 * tp + fp + fn), 6))


def recall(ranks: DataFrame, must_have: DataFrame, k: int, k_small: int = 5) -> DataFrame:
    """(qid, n, recall, recall_small, worst_rank) of labels (qid, id); an item that is not ranked has no rank. Questions without labels are unscored."""
    met = must_have.join(ranks.select("qid", "id", "place"), ["qid", "id"], "left")
    return met.groupBy("qid").agg(
        F.count("*").alias("n"), F.round(F.count_if(F.col("place") <= k) / F.count("*"), 6).alias("recall"),
        F.round(F.count_if(F.col("place") <= k_small) / F.count("*"), 6).alias("recall_small"), F.max("place").alias("worst_rank"),
    )


def verdicts(current: DataFrame, baseline: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(qid, old, new, state): same, better, worse beyond tolerance, new or gone."""
    joined = baseline.select("qid", F.col("recall").alias("old")).join(current.select("qid", F.col("recall").alias("new")), "qid", "full_outer")
    change = F.col("new") - F.col("old")
    return joined.withColumn("state", F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(change < -tolerance, "worse").when(change > tolerance, "better").otherwise("same"))


def citation_precision(answers: DataFrame) -> DataFrame:
    """(aid, precision): share of an answer's markers that were served; 1 without markers. answers (aid, answer, served array<int>)."""
    found = text.markers(F.col("answer"))
    good = F.size(F.filter(found, lambda n: F.array_contains("served", n)))
    return answers.select("aid", F.round(F.when(F.size(found) == 0, 1.0).otherwise(good / F.size(found)), 6).alias("precision"))


def faithfulness(lines: DataFrame) -> DataFrame:
    """(aid, faithfulness): mean of S 1, P 0.5 and N 0 over an answer's readable verdict lines (aid, line)."""
    mark = text.verdict(F.col("line"))["mark"]
    return lines.groupBy("aid").agg(F.round(F.avg(F.when(mark == "S", 1.0).when(mark == "P", 0.5).when(mark == "N", 0.0)), 6).alias("faithfulness"))


def quality_gate(scores: DataFrame, baseline: float) -> DataFrame:
    """One row: means of scores (faithfulness, precision, relevance) and whether they pass."""
    means = scores.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("faithfulness", "precision", "relevance")])
    return means.withColumn("passed", (F.col("faithfulness") >= 0.95) & (F.col("precision") >= 1.0) & (F.col("relevance") >= baseline - 0.05))


def rare_identifiers(docs: DataFrame, least: int = 2) -> DataFrame:
    """(id, term, n): tokens of a body seen least times in it, absent from every title, and in that one document only. docs (id, title, body)."""
    counts = docs.select("id", F.explode(text.tokens(F.col("body"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))
    alone = counts.groupBy("term").agg(F.count("*").alias("df"), F.max("id").alias("id"), F.max("n").alias("n")).where((F.col("df") == 1) & (F.col("n") >= least))
    titles = docs.select(F.explode(text.tokens(F.col("title"))).alias("term")).distinct()
    return alone.join(titles, "term", "left_anti").select("id", "term", "n")


def role_coverage(sources: DataFrame, taxonomy: DataFrame, thin: int = 5) -> DataFrame:
    """(role, n_sources, state) of every role of the taxonomy (role): zero, thin under thin sources, or ok. sources (name, target_roles)."""
    named = sources.select("name", F.explode(F.array_distinct("target_roles")).alias("role")).groupBy("role").agg(F.count("*").alias("n"))
    joined = taxonomy.join(named, "role", "left").select("role", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_sources"))
    return joined.withColumn("state", F.when(F.col("n_sources") == 0, "zero").when(F.col("n_sources") < thin, "thin").otherwise("ok"))


def newest_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("r = 1").drop("r")


def judged_only(gates: DataFrame) -> DataFrame:
    """Rows of gates (gate_skipped) that a gate has judged: what let items pass unseen counts in no statistics."""
    return gates.where(~F.coalesce("gate_skipped", F.lit(False)))


def recall_levels(recalls: DataFrame) -> DataFrame:
    """(level, grp, qid, n, recall, recall_small, worst_rank) of recall() with a column grp: overall, by group and by question, in one pass of grouping sets."""
    rolled = recalls.rollup("grp", "qid").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("recall_small"), 6).alias("recall_small"), F.max("worst_rank").alias("worst_rank"),
    )
    level = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "group").otherwise("question")
    return rolled.select(level.alias("level"), "grp", "qid", "n", "recall", "recall_small", "worst_rank")


def misses(ranks: DataFrame, must_have: DataFrame, k: int) -> DataFrame:
    """(qid, id, place) of the labels (qid, id) that are not among the first k, with the place that they have, null where they have none."""
    return must_have.join(ranks.select("qid", "id", "place"), ["qid", "id"], "left").where(F.col("place").isNull() | (F.col("place") > k)).select("qid", "id", "place")


def flips(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(id, state) of judged rows (id, label, predicted): fixed, broken, right, wrong, and new or gone where only one side has it."""
    good = lambda side: F.col(f"{side}.label") == F.col(f"{side}.predicted")
    met = current.alias("c").join(baseline.alias("b"), F.col("c.id") == F.col("b.id"), "full_outer")
    state = (
        F.when(F.col("b.id").isNull(), "new").when(F.col("c.id").isNull(), "gone").when(good("c") & ~good("b"), "fixed").when(~good("c") & good("b"), "broken")
        .when(good("c"), "right").otherwise("wrong")
    )
    return met.select(F.coalesce("c.id", "b.id").alias("id"), state.alias("state"))


def answer_report(answers: DataFrame) -> DataFrame:
    """One row over answers (relevance, refused, answerable, cited, must_have): mean relevance of those judged, share of right refusals, share with a needed item among those that need one."""
    needs = F.size(F.coalesce("must_have", F.array().cast("array<bigint>"))) > 0
    hit = F.coalesce(F.arrays_overlap("cited", "must_have"), F.lit(False))
    return answers.agg(
        F.count("*").alias("n"), F.round(F.avg("relevance"), 6).alias("relevance"), F.round(F.avg((F.col("refused") != F.col("answerable")).cast("int")), 6).alias("refusals_right"),
        F.round(F.avg(F.when(needs, hit.cast("int"))), 6).alias("must_have_hit"),
    )
