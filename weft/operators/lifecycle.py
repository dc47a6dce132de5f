"""Changes of state as new versions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft import vocab
from weft.functions import scoring


def transition(docs: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """docs with the new status of changes (id, new_status); terminal states stamp analyzed_at."""
    joined = docs.join(changes, "id", "left")
    return joined.select(
        "id", F.coalesce("new_status", "status").alias("status"), F.when(F.col("new_status").isin(vocab.TERMINAL_STATES), as_of).otherwise(F.col("analyzed_at")).alias("analyzed_at"),
    )


def reset_failed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")))


def insert_new(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """table with the rows whose key it does not have, the first by order of each new key; rows without a key are never added."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    first = rows.where(F.col(key).isNotNull()).withColumn("__place", place).where("__place = 1").drop("__place")
    return table.unionByName(first.join(table.select(key).distinct(), key, "left_anti").select(table.columns))


def orphans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without an item; nulls among the items' ids hide none."""
    return docs.join(items.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_anti")


def replace_children(children: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Children of parents in fresh replaced by those of fresh."""
    return children.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def purge(docs: DataFrame, items: DataFrame, chunks: DataFrame, as_of, days: int = vocab.MAX_AGE_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables after a purge, all from one snapshot: old documents keep only their fingerprint, their items expire, their chunks go."""
    old = docs.where(F.coalesce("published_at", "created_at") < as_of - F.make_dt_interval(F.lit(days))).select("id").distinct().withColumn("old", F.lit(True))
    marked = docs.join(old, "id", "left")
    kept = marked.withColumn("content", F.when(F.col("old"), None).otherwise(F.col("content"))).withColumn("status", F.when(F.col("old"), "expired").otherwise(F.col("status"))).drop("old")
    expired = items.join(old, "id", "left").withColumn("status", F.when(F.col("old"), "expired").otherwise(F.col("status"))).drop("old")
    return kept, expired, chunks.join(old.select("id"), "id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; new values win, nulls of new leave the old ones."""
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns])


def backfill_scores(items: DataFrame, as_of) -> DataFrame:
    """Items without a score get one with the tier, from a middling gate score and remapped event type."""
    event = scoring.remapped_event(F.col("event_type"))
    score = scoring.actionability(F.lit(0.5), F.col("confidence"), F.col("trust_score"), event, F.col("published_at"), as_of)
    filled = items.withColumn("event_type", event).withColumn("__score", F.coalesce("score", score))
    return filled.withColumn("tier", F.when(F.col("score").isNull(), scoring.tier(F.col("__score"), F.col("event_type"))).otherwise(F.col("tier"))).withColumn("score", F.col("__score")).drop("__score")


def last_events(events: DataFrame) -> DataFrame:
    """(request, kind, payload): the last event of each request; a commit or error replaces the tokens before it."""
    return events.withColumn("r", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("seq")))).where("r = 1").select("request", "kind", "payload")


def backfill_dates(docs: DataFrame) -> DataFrame:
    """Documents without a date of publication take that of their fetch; terminal ones without analyzed_at take updated_at."""
    done = F.col("status").isin(vocab.TERMINAL_STATES)
    return docs.withColumns({
        "published_at": F.coalesce("published_at", "fetched_at"),
        "analyzed_at": F.coalesce("analyzed_at", F.when(done, F.col("updated_at"))),
    })


def change_subscribers(subscribers: DataFrame, changes: DataFrame) -> DataFrame:
    """subscribers with what changes (subscriber, roles, active; one row each) set; nulls leave the old, unknown ones change nothing."""
    new = changes.select("subscriber", F.col("roles").alias("__roles"), F.col("active").alias("__active"))
    changed = subscribers.join(new, "subscriber", "left")
    return changed.withColumns({"roles": F.coalesce("__roles", "roles"), "active": F.coalesce("__active", "active")}).select(subscribers.columns)


def remove_subscribers(subscribers: DataFrame, gone: DataFrame) -> DataFrame:
    return subscribers.join(gone.select("subscriber"), "subscriber", "left_anti").select(subscribers.columns)


def deactivate(subscribers: DataFrame, tokens: DataFrame) -> DataFrame:
    """subscribers whose token is among tokens (token) stay as inactive ones; null and unknown tokens change nothing."""
    used = tokens.select("token").distinct().withColumn("__used", F.lit(True))
    return subscribers.join(used, "token", "left").withColumn("active", F.col("active") & F.col("__used").isNull()).select(subscribers.columns)
