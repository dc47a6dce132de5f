"""Intake of entries: length and age filters, fingerprints, first-wins deduplication against a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft import vocab
from weft.functions import text


def outcomes(entries: DataFrame, ledger: DataFrame | None, as_of, min_content: int = vocab.MIN_CONTENT, max_age_days: int = vocab.MAX_AGE_DAYS) -> DataFrame:
    """Entries (url, title, raw_content, published_at, position, config) with content, fingerprint and outcome.

    outcome: too_short, too_old, known (in the ledger of fingerprints, or seen before in this batch by position), new.
    config is JSON whose min_content_length overrides min_content. A missing date is as_of.
    """
    clean = entries.select("*", text.html_text(F.col("raw_content")).alias("content"), text.fingerprint(F.col("url"), F.coalesce("title", F.lit(""))).alias("fingerprint"))
    least = F.coalesce(F.try_variant_get(F.try_parse_json("config"), "$.min_content_length", "int"), F.lit(min_content))
    aged = F.coalesce("published_at", as_of) < as_of - F.make_dt_interval(F.lit(max_age_days))
    early = clean.withColumn("outcome", F.when(F.length("content") < least, "too_short").when(aged, "too_old"))
    # only entries that pass the cheap filters can be the first of their fingerprint
    place = F.row_number().over(Window.partitionBy("fingerprint", F.col("outcome").isNull()).orderBy("position"))
    placed = early.withColumn("place", place)
    if ledger is not None:
        placed = placed.join(ledger.select("fingerprint", F.lit(True).alias("held")).distinct(), "fingerprint", "left")
    else:
        placed = placed.withColumn("held", F.lit(None).cast("boolean"))
    done = F.coalesce("outcome", F.when(F.col("held") | (F.col("place") > 1), "known").otherwise("new"))
    return placed.withColumn("outcome", done).drop("place", "held")


def summary(marked: DataFrame) -> DataFrame:
    return marked.groupBy("outcome").agg(F.count("*").alias("n"))


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__place = 1").drop("__place")


def work_queue(docs: DataFrame, limit: int, used_today: int, daily_cap: int) -> DataFrame:
    """Pending documents, newest first, as many as the day's remaining budget allows."""
    return docs.where("status = 'pending'").orderBy(F.col("published_at").desc_nulls_last(), "id").limit(max(0, min(limit, daily_cap - used_today)))


def day_budgets(events: DataFrame) -> DataFrame:
    """(day, analysed, any_calls, calls, searches) of each UTC day of events (ts, event_type, value): views are analyses, clicks paid calls, errors searches."""
    calls = F.coalesce(F.sum(F.when(F.col("event_type") == "click", F.col("value"))), F.lit(0.0))
    return events.groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("event_type") == "view").alias("analysed"), (calls > 0).alias("any_calls"), F.round(calls, 4).alias("calls"), F.count_if(F.col("event_type") == "error").alias("searches"))


def status_counts(routed: DataFrame) -> DataFrame:
    """(status, n): how many documents an analysis made, skipped and failed."""
    return routed.groupBy("status").agg(F.count("*").alias("n"))
