"""Digests: the most important unsent items of each subscriber by role."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft import vocab
from weft.functions.scoring import importance
from weft.operators.catalog import visible
from weft.operators.lineage import cut


def active(subscribers: DataFrame) -> DataFrame:
    return subscribers.where(F.col("active") & (F.size("roles") > 0))


def rested(subscribers: DataFrame, log: DataFrame, as_of, hours: int = vocab.COOLDOWN_HOURS) -> DataFrame:
    """Subscribers to whom nothing was sent in the last hours."""
    recent = log.where(F.col("sent_at") > as_of - F.make_dt_interval(F.lit(0), F.lit(hours))).select("subscriber").distinct()
    return subscribers.join(recent, "subscriber", "left_anti")


def lately(items: DataFrame, as_of, hours: int = vocab.LOOKBACK_HOURS) -> DataFrame:
    """What a digest may offer: visible items made in the last hours before as_of."""
    return visible(items).where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))


def matches(people: DataFrame, items: DataFrame) -> DataFrame:
    """(profile, id, role, role_pos) of people (profile, roles): a row for each shared role, and one of the company-wide role for items of it.

    Roles are exploded on both sides and joined, so no pair without a match is made.
    """
    asked = people.select("profile", F.posexplode("roles").alias("role_pos", "role"))
    wide = people.select("profile", F.lit(LAST).alias("role_pos"), F.lit(vocab.COMPANY_WIDE).alias("role"))
    held = items.select("id", F.explode(F.array_distinct("roles")).alias("role"))
    return asked.union(wide).join(held, "role").select("profile", "id", "role", "role_pos")


#: Place of the company-wide section after all roles.
LAST = 1_000_000


def ranked(profiles: DataFrame, items: DataFrame) -> DataFrame:
    """(profile, id, role, key, published_at, candidates, r): the items of each list of roles (profile, roles) under their owning role.

    An item belongs to the shared role of highest importance, the first of equal ones; to the company-wide section
    where no role is shared. r is its place in that role, candidates the items of the profile.
    """
    keyed = matches(profiles, items).join(items, "id").withColumn("key", importance(F.col, F.col("role")))
    own = Window.partitionBy("profile", "id").orderBy(F.col("role_pos") == LAST, F.desc("key"), "role_pos")
    owned = keyed.withColumn("o", F.row_number().over(own)).where("o = 1")
    place = F.row_number().over(Window.partitionBy("profile", "role").orderBy(*by_importance()))
    return owned.select("profile", "id", "role", "key", "published_at", F.count("*").over(Window.partitionBy("profile")).alias("candidates"), place.alias("r"))


def by_importance():
    return [F.desc("key"), F.col("published_at").desc_nulls_last(), F.col("id")]


def select(subscribers: DataFrame, items: DataFrame, log: DataFrame, kind: str = "brief", per_role: int = vocab.PER_ROLE, per_digest: int = vocab.PER_DIGEST) -> DataFrame:
    """(subscriber, id, role, place, section, overflow): what each subscriber gets.

    per_role items of each role and per_digest in all are chosen; sections come in the order of their first item;
    overflow counts the candidates left out. Items sent before are out.

    Importance depends on the item and the role alone, so items are ranked once for each distinct list of roles. A
    subscriber then meets only the first per_role items of each role and as many more as were sent to them.
    """
    people = active(subscribers).select("subscriber", "roles", F.xxhash64("roles").alias("profile"))
    order = cut(ranked(people.select("profile", "roles").distinct(), visible(items)))
    sent = log.where(F.col("kind") == kind).select("subscriber", "id").distinct()
    out = cut(sent.join(people.select("subscriber", "profile"), "subscriber").join(order.select("profile", "id"), ["profile", "id"]).select("subscriber", "id"))
    numbers = people.select("subscriber", "profile").join(out.groupBy("subscriber").agg(F.count("*").alias("n_sent")), "subscriber", "left")
    numbers = numbers.withColumn("n_sent", F.coalesce("n_sent", F.lit(0)))
    wanted = numbers.select("subscriber", "profile", "n_sent", F.explode(F.sequence(F.lit(1), (F.col("n_sent") + per_role).cast("int"))).alias("r"))
    found = wanted.join(order, ["profile", "r"]).join(out, ["subscriber", "id"], "left_anti")
    in_role = found.withColumn("r", F.row_number().over(Window.partitionBy("subscriber", "role").orderBy(*by_importance()))).where(F.col("r") <= per_role)
    everything = Window.partitionBy("subscriber")
    chosen = in_role.withColumn("place", F.row_number().over(everything.orderBy(*by_importance()))).where(F.col("place") <= per_digest)
    return chosen.select(
        "subscriber", "id", "role", "place", F.min("place").over(Window.partitionBy("subscriber", "role")).alias("section"),
        (F.col("candidates") - F.col("n_sent") - F.count("*").over(everything)).alias("overflow"),
    )


def logged(log: DataFrame, chosen: DataFrame, results: DataFrame, kind: str, as_of) -> DataFrame:
    """New rows of the ledger: what was chosen for subscribers whose sending went well, rows already there left out."""
    ok = results.where("ok").select("subscriber").distinct()
    new = chosen.join(ok, "subscriber", "left_semi").select("subscriber", "id", F.lit(kind).alias("kind"), as_of.alias("sent_at")).dropDuplicates(["subscriber", "id", "kind"])
    return new.join(log.select("subscriber", "id", "kind"), ["subscriber", "id", "kind"], "left_anti").select("subscriber", "id", "kind", "sent_at")


def brief(subscribers: DataFrame, items: DataFrame, log: DataFrame, as_of, hours: int = vocab.LOOKBACK_HOURS, force: bool = False, **limits) -> DataFrame:
    """One run of a brief: select() for the subscribers past their cool-down, over the items that a digest of that time may offer. force drops the cool-down."""
    people = subscribers if force else rested(subscribers, log, as_of)
    return select(people, lately(items, as_of, hours), log, **limits)


def run_counts(subscribers: DataFrame, chosen: DataFrame, results: DataFrame) -> DataFrame:
    """One row: sent, failed and skipped of a run's active subscribers; those without a digest are skipped."""
    built = chosen.select("subscriber").distinct().join(results.select("subscriber", "ok"), "subscriber", "left")
    met = active(subscribers).select("subscriber").distinct().join(built.withColumn("built", F.lit(True)), "subscriber", "left")
    made, ok = F.coalesce("built", F.lit(False)), F.coalesce("ok", F.lit(False))
    return met.agg(F.count_if(made & ok).alias("sent"), F.count_if(made & ~ok).alias("failed"), F.count_if(~made).alias("skipped"))
