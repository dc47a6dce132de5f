"""The domain's tables derived from the driver tables, in Spark and in DuckDB SQL side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import vocab
from weft.functions import scoring, text

AS_OF = "2026-08-01 00:00:00"
BASE = "2026-07-31 00:00:00"
TIERS = ["very_high", "high", "medium", "low", "unverified", "unknown"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(df: DataFrame, *names: str) -> DataFrame:
    """df with the columns of names as 64-bit numbers, as SQL's places and counts are."""
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def as_of() -> Column:
    return F.expr(f"timestamp_ntz'{AS_OF}'")


def pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(map(sql_text, values)) + "]"


def sql_pick(values: list[str], n: str) -> str:
    return f"{sql_list(values)}[({n}) % {len(values)} + 1]"


def sql_case(key: str, values: dict, default) -> str:
    lit = lambda v: sql_text(v) if isinstance(v, str) else str(v)
    return f"case {key} " + " ".join(f"when {sql_text(k)} then {lit(v)}" for k, v in values.items()) + f" else {lit(default)} end"


def before(hours: Column) -> Column:
    return F.expr(f"timestamp_ntz'{BASE}'") - F.make_dt_interval(F.lit(0), hours.cast("int"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched items, one for each document; everything but the text follows from the id by rule."""
    k = F.col("id")
    base = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    made = base.select(
        "id", "lang", "source", F.col("text").alias("body"), F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80).alias("title"),
        pick(vocab.EVENT_TYPES, k).alias("event_type"), pick(vocab.NATURES, k).alias("nature"),
        F.array(pick(vocab.TOPICS, k), pick(vocab.TOPICS, k * 5 + 3)).alias("topics"), F.array(pick(vocab.ROLES, k), pick(vocab.ROLES, k * 2 + 1)).alias("roles"),
        pick(TIERS, k).alias("trust_tier"), ((k % 97) / 97.0).alias("confidence"), ((k % 89) / 89.0).alias("gate_score"),
        F.when(k % 8 == 0, "draft").otherwise("published").alias("status"), (k % 11 != 0).alias("is_primary"), (k - k % 3).alias("cluster_id"),
        F.when(k % 13 != 0, before(k * 37 % 9000)).alias("published_at"), before(k * 29 % 4000).alias("created_at"),
        F.when(k % 4 != 0, F.create_map(pick(vocab.ROLES, k), F.struct(pick([*vocab.ACTION_TYPES, "buy"], k).alias("action_type"), pick(["read it", " ", "try it"], k * 3 + 1).alias("note"), pick([*vocab.ROLE_URGENCY, "now"], k * 7).alias("urgency")))).alias("recommendations"),
        F.create_map(F.lit("has_security_patch"), k % 5 == 0, F.lit("has_benchmark"), k % 2 == 0).alias("indicators"),
    )
    scored = made.withColumn("trust_score", scoring.trust_score(F.col("trust_tier"))).withColumn("impact_label", scoring.impact_label(F.col("event_type")))
    scored = scored.withColumn("urgency", scoring.urgency(F.col("impact_label"), F.col("published_at"), as_of()))
    scored = scored.withColumn("score", scoring.actionability(F.col("gate_score"), F.col("confidence"), F.col("trust_score"), F.col("event_type"), F.col("published_at"), as_of()))
    return scored.withColumn("tier", scoring.tier(F.col("score"), F.col("event_type")))


def _age(ts: str) -> str:
    return f"floor(date_diff('second', {ts}, timestamp '{AS_OF}') / 86400)"


SQL_BASE = f"""made as (select doc_id as id, lang, source, text as body, substr(split_part(text, chr(10), 1), 1, 80) as title,
 {sql_pick(vocab.EVENT_TYPES, "doc_id")} as event_type, {sql_pick(vocab.NATURES, "doc_id")} as nature,
 [{sql_pick(vocab.TOPICS, "doc_id")}, {sql_pick(vocab.TOPICS, "doc_id * 5 + 3")}] as topics, [{sql_pick(vocab.ROLES, "doc_id")}, {sql_pick(vocab.ROLES, "doc_id * 2 + 1")}] as roles,
 {sql_pick(TIERS, "doc_id")} as trust_tier, (doc_id % 97) / 97.0::double as confidence, (doc_id % 89) / 89.0::double as gate_score,
 case when doc_id % 8 = 0 then 'draft' else 'published' end as status, doc_id % 11 <> 0 as is_primary, doc_id - doc_id % 3 as cluster_id,
 case when doc_id % 13 <> 0 then timestamp '{BASE}' - to_hours(doc_id * 37 % 9000) end as published_at, timestamp '{BASE}' - to_hours(doc_id * 29 % 4000) as created_at,
 case when doc_id % 4 <> 0 then {sql_pick(vocab.ROLES, "doc_id")} end as rec_role, {sql_pick([*vocab.ACTION_TYPES, "buy"], "doc_id")} as rec_action,
 {sql_pick(["read it", " ", "try it"], "doc_id * 3 + 1")} as rec_note, {sql_pick([*vocab.ROLE_URGENCY, "now"], "doc_id * 7")} as rec_urgency, doc_id % 5 = 0 as practical
 from documents),
trusted as (select *, {sql_case("trust_tier", vocab.TRUST_SCORE, vocab.TRUST_DEFAULT)}::double as trust_score, {sql_case("event_type", vocab.IMPACT_BY_EVENT, vocab.IMPACT_DEFAULT)} as impact_label, {_age("published_at")} as age from made),
scored as (select *, case when published_at is null then case impact_label when 'Nghiêm trọng' then 'critical' when 'Cao' then 'medium' when 'Trung bình' then 'medium' else 'low' end
 when impact_label = 'Nghiêm trọng' and age < 14 then 'critical' when impact_label = 'Cao' and age < 14 then 'high' when impact_label in ('Trung bình', 'Cao') then 'medium' else 'low' end as urgency,
 round(least(1.0, greatest(0.0, 0.25::double * gate_score + 0.20::double * confidence + 0.15::double * trust_score + 0.25::double * {sql_case("event_type", vocab.EVENT_WEIGHT, vocab.EVENT_WEIGHT_DEFAULT)}::double
 + 0.15::double * case when published_at is null then 0.25::double when greatest(0, age) <= 30 then greatest(0.1::double, 1 - greatest(0, age) / 30.0::double * 0.75::double) else 0.1::double end)), 4) as score from trusted),
items as (select *, case when event_type in ({", ".join(map(sql_text, vocab.TACTICAL_EVENTS))}) and score >= 0.6 then 'Tactical' when event_type in ({", ".join(map(sql_text, vocab.TACTICAL_EVENTS))}) and score >= 0.4 then 'Operational'
 when event_type in ({", ".join(map(sql_text, vocab.STRATEGIC_EVENTS))}) then 'Strategic' when score >= 0.5 then 'Operational' else 'Informational' end as tier from scored)"""


def sql(body: str, *more: str) -> str:
    """A query over items and further common tables."""
    return "with " + ",\n".join([SQL_BASE, *more]) + "\n" + body


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of the documents and one without any; active but for those ending in 3."""
    named = read(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    return named.union(spark.createDataFrame([("empty",)], "name string")).withColumn("active", ~F.col("name").endswith("3"))


SQL_SOURCES = "sources as (select name, not ends_with(name, '3') as active from (select distinct source as name from documents union all select 'empty'))"


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subscriber for each customer, with one to three roles; some inactive, some without roles."""
    k = F.col("c_custkey")
    roles = F.slice(F.array(pick(vocab.ROLES, k), pick(vocab.ROLES, k + 2), pick(vocab.ROLES, k + 5)), 1, (k % 4).cast("int"))
    return read(spark, sf_dir, "customer").select(k.alias("subscriber"), roles.alias("roles"), (k % 10 != 0).alias("active"))


SQL_SUBSCRIBERS = f"""subscribers as (select c_custkey as subscriber, ([{sql_pick(vocab.ROLES, "c_custkey")}, {sql_pick(vocab.ROLES, "c_custkey + 2")}, {sql_pick(vocab.ROLES, "c_custkey + 5")}])[1:(c_custkey % 4)] as roles,
 c_custkey % 10 <> 0 as active from customer)"""


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger: an item sent to a user at each purchase or signup event."""
    e = read(spark, sf_dir, "events").where("event_type in ('purchase', 'signup')")
    return e.select(F.col("user_id").alias("subscriber"), (F.col("event_id") % 500).alias("id"), F.when(F.col("event_type") == "signup", "welcome").otherwise("brief").alias("kind"), F.col("ts").alias("sent_at"))


SQL_DELIVERIES = "deliveries as (select user_id as subscriber, event_id % 500 as id, case when event_type = 'signup' then 'welcome' else 'brief' end as kind, ts as sent_at from events where event_type in ('purchase', 'signup'))"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages as connector rows; every seventh repeats the address and title of the page before."""
    k = F.col("page_id")
    p = read(spark, sf_dir, "pages")
    return p.select(
        k.alias("position"), F.concat(F.lit("https://e.example/"), F.when(k % 7 == 0, k - 1).otherwise(k).cast("string")).alias("url"),
        F.concat(F.lit(" Page "), F.when(k % 7 == 0, k - 1).otherwise(k).cast("string")).alias("title"), F.col("html").alias("raw_content"),
        F.when(k % 9 != 0, before(k * 41 % 9000)).alias("published_at"), F.when(k % 5 == 0, F.lit('{"min_content_length": 1500}')).when(k % 5 == 1, F.lit("not json")).alias("config"),
    )
