"""Digests and event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft import vocab
from weft.functions import text
from weft.operators import digest, lifecycle
from weft.plans import corpus
from weft.plans.corpus import as_of, items, read, sql, sql_case, sql_text
from weft.plans.registry import registry

QUERIES, ORACLES, query = registry()


URGENCY = f"case when rec_role = role then case rec_urgency when 'high' then 3 when 'low' then 1 else 2 end else 2 end"
SQL_DIGEST = f"""ready as (select * from items where status = 'published' and is_primary),
people as (select subscriber, roles from subscribers where active and len(roles) > 0),
asked as (select subscriber, unnest(roles) as role, unnest(range(len(roles))) as pos from people),
held as (select id, unnest(list_distinct(roles)) as role from ready),
found as (select subscriber, id, role, pos from asked join held using (role) union all select p.subscriber, r.id, {sql_text(vocab.COMPANY_WIDE)}, 1000000 from people p, ready r where list_contains(r.roles, {sql_text(vocab.COMPANY_WIDE)})),
unsent as (select * from found f where not exists (select 1 from deliveries d where d.kind = 'brief' and d.subscriber = f.subscriber and d.id = f.id)),
keyed as (select u.*, i.published_at, {URGENCY} as a, {sql_case('impact_label', vocab.IMPACT_RANK, 0)} as b, practical::int as c, score as d, (tier = 'Strategic')::int as e, trust_score as f, epoch(coalesce(published_at, created_at)) as g from unsent u join items i using (id)),
owned as (select *, row_number() over (partition by subscriber, id order by pos = 1000000, a desc, b desc, c desc, d desc, e desc, f desc, g desc, pos) as o from keyed),
in_role as (select *, count(*) over (partition by subscriber) as candidates, row_number() over (partition by subscriber, role order by a desc, b desc, c desc, d desc, e desc, f desc, g desc, published_at desc nulls last, id) as r from owned where o = 1),
placed as (select *, row_number() over (partition by subscriber order by a desc, b desc, c desc, d desc, e desc, f desc, g desc, published_at desc nulls last, id) as place from in_role where r <= 2),
chosen as materialized (select subscriber, id, role, place, min(place) over (partition by subscriber, role) as section, candidates - count(*) over (partition by subscriber) as overflow from placed where place <= 3)"""


@query(sql("select subscriber, id, role, place, section, overflow from chosen", corpus.SQL_SUBSCRIBERS, corpus.SQL_DELIVERIES, SQL_DIGEST))
def digests(spark, sf_dir):
    """The items of each subscriber's digest."""
    return corpus.longs(digest.select(corpus.subscribers(spark, sf_dir), items(spark, sf_dir), corpus.deliveries(spark, sf_dir)), "place", "section")


NOW = "2024-01-20 00:00:00"


@query("with " + corpus.SQL_SUBSCRIBERS + ", " + corpus.SQL_DELIVERIES + " select subscriber from subscribers s where not exists (select 1 from deliveries d where d.subscriber = s.subscriber and d.sent_at > (select max(sent_at) from deliveries) - interval 48 hours)")
def rested_subscribers(spark, sf_dir):
    """Subscribers past their cool-down at the time of the last delivery."""
    log = corpus.deliveries(spark, sf_dir)
    return digest.rested(corpus.subscribers(spark, sf_dir), log, log.agg(F.max("sent_at")).scalar()).select("subscriber")


@query(sql("select subscriber, id, 'brief' as kind from chosen where subscriber % 3 <> 0", corpus.SQL_SUBSCRIBERS, corpus.SQL_DELIVERIES, SQL_DIGEST))
def delivery_log(spark, sf_dir):
    """New ledger rows of digests whose sending went well."""
    people, log = corpus.subscribers(spark, sf_dir), corpus.deliveries(spark, sf_dir)
    chosen = digest.select(people, items(spark, sf_dir), log)
    results = people.select("subscriber", (F.col("subscriber") % 3 != 0).alias("ok"))
    return digest.logged(log, chosen, results, "brief", as_of()).select("subscriber", "id", "kind")


def _stream(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("request"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "error", "error").otherwise("token").alias("kind"), F.col("event_type").alias("payload"))


@query("select user_id as request, case event_type when 'purchase' then 'commit' when 'error' then 'error' else 'token' end as kind, event_type as payload from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1")
def last_events(spark, sf_dir):
    return lifecycle.last_events(_stream(spark, sf_dir))


@query("select event_id, sha256('event: ' || event_type || chr(10) || 'data: {\"k\":' || event_id || '}' || chr(10) || chr(10)) as frame_sha256 from events")
def event_frames(spark, sf_dir):
    payload = F.to_json(F.struct(F.col("event_id").alias("k")))
    return read(spark, sf_dir, "events").select("event_id", F.sha2(text.sse_frame(F.col("event_type"), payload), 256).alias("frame_sha256"))


@query("select user_id, event_type, count(*) as n, round(sum(value), 4) as total, row_number() over (partition by user_id order by count(*) desc, event_type) as place from events group by 1, 2 qualify row_number() over (partition by user_id order by count(*) desc, event_type) <= 2")
def top_event_types(spark, sf_dir):
    """The two commonest event types of each user."""
    from pyspark.sql import Window

    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))
    return corpus.longs(counts.withColumn("place", place).where("place <= 2"), "place")


@query(sql(f"select id, created_at from items where status = 'published' and is_primary and created_at >= timestamp '{corpus.AS_OF}' - interval 108 hours"))
def digest_candidates(spark, sf_dir):
    """Items that the next digest may offer."""
    return digest.lately(items(spark, sf_dir), as_of()).select("id", "created_at")
