"""Catalog queries: pages, counts, joins, scoring rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft import vocab
from weft.functions import scoring, text
from weft.operators import catalog, lifecycle
from weft.plans import corpus
from weft.plans.corpus import as_of, items, read, sql, sql_case, sql_text
from weft.plans.registry import registry

QUERIES, ORACLES, query = registry()


BY = catalog.Filters(roles=["Security", "Dev"], urgency=["critical", "high", "medium"], search="er")
WHERE = "status = 'published' and is_primary and list_has_any(roles, ['Security', 'Dev']) and urgency in ('critical', 'high', 'medium') and (coalesce(title ilike '%er%', false) or coalesce(body ilike '%er%', false) or event_type ilike '%er%' or impact_label ilike '%er%' or nature ilike '%er%')"
COLUMNS = ["id", "title", "source", "urgency", "impact_label", "tier", "score", "published_at"]


@query(sql(f"select {', '.join(COLUMNS)} from items where {WHERE} order by {sql_case('impact_label', vocab.IMPACT_ORDER, 6)}, published_at desc nulls last, id limit 20"))
def visible_page(spark, sf_dir):
    """First page of visible items by impact, under several filters."""
    return catalog.page(items(spark, sf_dir), BY, "impact").select(*COLUMNS)


@query(sql("select id, urgency, score from items where status = 'published' and is_primary and tier in ('Tactical', 'Strategic') and source in ('src0', 'src1') order by score desc nulls last, published_at desc nulls last, id limit 15 offset 15"))
def second_page_by_score(spark, sf_dir):
    by = catalog.Filters(tiers=["Tactical", "Strategic"], sources=["src0", "src1"])
    return catalog.page(items(spark, sf_dir), by, "score", number=2, size=15).select("id", "urgency", "score")


@query(sql(f"select count(*) as total from items where {WHERE} and published_at >= timestamp '2026-05-01 00:00:00'"))
def page_total(spark, sf_dir):
    return catalog.total(items(spark, sf_dir), catalog.Filters(BY.roles, BY.urgency, search=BY.search, since="2026-05-01 00:00:00"))


@query(sql(f"select count(*) as total, count(*) filter (impact_label in ({', '.join(map(sql_text, vocab.KPI_IMPACTS))})) as high_impact, count(*) filter (nature in ({', '.join(map(sql_text, vocab.KPI_NATURES))})) as risks, (select count(*) from sources where active) as sources from items where status = 'published' and is_primary", corpus.SQL_SOURCES))
def kpis(spark, sf_dir):
    return catalog.kpis(items(spark, sf_dir), corpus.sources(spark, sf_dir))


@query(sql("select s.name, count(i.id) as n_items from sources s left join items i on i.source = s.name and i.status = 'published' and i.is_primary group by 1", corpus.SQL_SOURCES))
def source_counts(spark, sf_dir):
    return catalog.source_counts(corpus.sources(spark, sf_dir), items(spark, sf_dir))


@query(sql("select id, cluster_id, (select count(*) from items b where b.cluster_id = a.cluster_id and b.id <> a.id and b.status = 'published') as n_others from items a where cluster_id is not null"))
def cluster_references(spark, sf_dir):
    return catalog.references(items(spark, sf_dir))


@query(sql("""select list_id, pos, id, title from (select l.list_id, i.id, i.title, row_number() over (partition by l.list_id order by l.at) as pos from
 (select c_custkey as list_id, unnest([c_custkey * 3, 999999999, c_custkey, c_custkey + 7, c_custkey * 2]) as id, unnest(range(5)) as at from customer) l join items i on i.id = l.id) where pos <= 3"""))
def load_by_ids(spark, sf_dir):
    k = F.col("c_custkey")
    wanted = read(spark, sf_dir, "customer").select(k.alias("list_id"), F.array(k * 3, F.lit(999999999), k, k + 7, k * 2).alias("ids"))
    return corpus.longs(catalog.by_ids(items(spark, sf_dir), wanted, 3), "pos")


@query(sql("select id, urgency, trust_score, impact_label, score, tier from items"))
def item_scores(spark, sf_dir):
    return items(spark, sf_dir).select("id", "urgency", "trust_score", "impact_label", "score", "tier")


@query(sql("select id, case when lang = 'vi' or list_contains(topics, 'Legal & Regulation') then 'high' when list_contains(topics, 'Team & Process') then 'medium' else 'low' end as relevance from items"))
def local_relevance(spark, sf_dir):
    return items(spark, sf_dir).select("id", scoring.relevance(F.col("lang"), F.col("topics")).alias("relevance"))


@query(sql(f"""select id, case when rec_role is not null and rec_action <> 'buy' and trim(rec_note) <> '' then rec_role || '|' || rec_action || '|' || trim(rec_note) || '|' || case when rec_urgency = 'now' then 'medium' else rec_urgency end end as recommendation,
 array_to_string(list_filter(roles || ['Chef'], lambda r: list_contains({corpus.sql_list(vocab.ROLES)}, r)), ',') as valid_roles, case when id % 5 < 4 then {corpus.sql_pick(vocab.ADOPTION_RINGS, 'id % 5')} end as ring from items"""))
def validated_fields(spark, sf_dir):
    """Role, recommendation and ring validation; a map of one entry is shown as text."""
    i = items(spark, sf_dir)
    recs = scoring.valid_recommendations(F.col("recommendations"), F.col("roles"))
    entry = F.map_entries(recs)[0]
    shown = F.concat_ws("|", entry["key"], entry["value"]["action_type"], entry["value"]["note"], entry["value"]["urgency"])
    ring = corpus.pick([*vocab.ADOPTION_RINGS, "Never"], F.col("id"))
    return i.select("id", F.when(recs.isNotNull(), shown).alias("recommendation"), F.array_join(scoring.valid_roles(F.concat("roles", F.array(F.lit("Chef")))), ",").alias("valid_roles"), scoring.valid_ring(ring).alias("ring"))


OLD_TOPICS = [*list(vocab.TOPIC_REMAP)[:9], "Data Engineering", "Unheard of", "LLM"]


@query(sql(f"""select id, case when len(kept) = 0 then 'DevTools & Frameworks' else array_to_string(kept, ',') end as topics from (select id, list_filter([n1, n2], lambda x, i: list_contains({corpus.sql_list(vocab.TOPICS)}, x) and (i = 1 or x <> n1 or not list_contains({corpus.sql_list(vocab.TOPICS)}, n1))) as kept from
 (select id, {sql_case(corpus.sql_pick(OLD_TOPICS, 'id'), vocab.TOPIC_REMAP, '?').replace("else '?'", f"else {corpus.sql_pick(OLD_TOPICS, 'id')}")} as n1, {sql_case(corpus.sql_pick(OLD_TOPICS, 'id * 7 + 2'), vocab.TOPIC_REMAP, '?').replace("else '?'", f"else {corpus.sql_pick(OLD_TOPICS, 'id * 7 + 2')}")} as n2 from items))"""))
def remapped_topics(spark, sf_dir):
    k = F.col("id")
    return items(spark, sf_dir).select("id", F.array_join(scoring.remapped_topics(F.array(corpus.pick(OLD_TOPICS, k), corpus.pick(OLD_TOPICS, k * 7 + 2))), ",").alias("topics"))


@query(sql(f"select id, case when id % 3 <> 0 and not regexp_matches(lower(title), '[{vocab.VIETNAMESE_LETTERS}]') then 'Summary ' || id else case when title = '' then '{vocab.NO_TITLE}' else trim(title) end end as shown from items"))
def display_titles(spark, sf_dir):
    summary = F.when(F.col("id") % 3 != 0, F.concat(F.lit(" Summary "), F.col("id").cast("string"), F.lit(" ")))
    return items(spark, sf_dir).select("id", text.display_title(F.col("title"), summary).alias("shown"))


@query("""select l_suppkey as pages, l_linenumber::bigint as current, row_number() over (partition by l_suppkey, l_linenumber order by n, label <> '…') as pos, label from (
 select l_suppkey, l_linenumber, n, unnest(case when n - lag(n) over (partition by l_suppkey, l_linenumber order by n) > 1 then ['…', n::varchar] else [n::varchar] end) as label from (
 select l_suppkey, l_linenumber, unnest(range(1, l_suppkey + 1)) as n from (select distinct l_suppkey, l_linenumber from lineitem where l_linenumber <= l_suppkey)) where n = 1 or n = l_suppkey or abs(n - l_linenumber) <= 1)""")
def page_links(spark, sf_dir):
    pairs = read(spark, sf_dir, "lineitem").where("l_linenumber <= l_suppkey").select(F.col("l_suppkey").alias("pages"), F.col("l_linenumber").cast("bigint").alias("current")).distinct()
    return corpus.longs(catalog.page_links(pairs), "pos")


@query(sql("select id, case when published_at is null then '' when m < 1 then 'now' when m < 60 then m::bigint || ' min' when m < 1440 then floor(m / 60)::bigint || ' h' else floor(m / 1440)::bigint || ' d' end as age from (select id, published_at, floor(date_diff('second', published_at, timestamp '2026-07-31 00:30:00') / 60) as m from items)"))
def relative_times(spark, sf_dir):
    return items(spark, sf_dir).select("id", scoring.relative_time(F.col("published_at"), F.expr("timestamp_ntz'2026-07-31 00:30:00'")).alias("age"))


@query("select o_orderpriority as priority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by rollup (o_orderpriority)")
def urgency_rollup(spark, sf_dir):
    """Counts and sums by urgency with a grand total."""
    return read(spark, sf_dir, "orders").rollup(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(sql(f"select id, {sql_case('event_type', vocab.EVENT_REMAP, '?').replace(chr(39) + '?' + chr(39), 'event_type')} as event_type, round(least(1.0, 0.125 + 0.20::double * confidence + 0.15::double * trust_score + 0.25::double * {sql_case('event_type', vocab.EVENT_WEIGHT, vocab.EVENT_WEIGHT_DEFAULT)}::double + 0.15::double * case when published_at is null then 0.25::double when greatest(0, age) <= 30 then greatest(0.1::double, 1 - greatest(0, age) / 30.0::double * 0.75::double) else 0.1::double end), 4) as score from items where id % 2 = 0 union all select id, event_type, score from items where id % 2 = 1"))
def backfilled_scores(spark, sf_dir):
    """Even ids lost their score and get a new one."""
    lost = items(spark, sf_dir).withColumn("score", F.when(F.col("id") % 2 == 1, F.col("score")))
    return lifecycle.backfill_scores(lost, as_of()).select("id", "event_type", "score")


@query(sql("select id from items where status = 'published' and is_primary and id % 3 in (0, 1) and id % 4 = 2"))
def filtered_by_momentum(spark, sf_dir):
    """Visible items by momentum and relevance."""
    k = F.col("id")
    marked = items(spark, sf_dir).withColumns({"momentum": corpus.pick(["new", "rising", "mature"], k), "relevance": corpus.pick(["low", "low", "high", "medium"], k)})
    return catalog.filtered(marked, catalog.Filters(momentum=["new", "rising"], relevance=["high"])).select("id")


@query(sql("select tier, count(*) as n from items group by 1"))
def tier_distribution(spark, sf_dir):
    return catalog.tier_distribution(items(spark, sf_dir))


@query(sql("select id, len(roles) = 2 and list_contains(roles, 'Security') and list_contains(roles, 'Dev') as same from items"))
def equal_presets(spark, sf_dir):
    """Whether an item's roles are those of a preset, in any order."""
    return items(spark, sf_dir).select("id", catalog.same_preset(F.col("roles"), F.array(F.lit("Security"), F.lit("Dev"))).alias("same"))


@query(sql(f"select id, coalesce(published_at, created_at) as published_at, case when id % 4 in (0, 2, 3) then case when id % 6 = 0 then timestamp '{corpus.BASE}' else created_at end when id % 6 = 0 then timestamp '{corpus.BASE}' end as analyzed_at from items"))
def backfilled_dates(spark, sf_dir):
    """Dates of documents in every state, some with a date of analysis."""
    k = F.col("id")
    docs = items(spark, sf_dir).select(
        "id", "published_at", F.col("created_at").alias("fetched_at"), F.col("created_at").alias("updated_at"),
        corpus.pick(["analyzed", "pending", "failed", "low_signal"], k).alias("status"), F.when(k % 6 == 0, F.expr(f"timestamp_ntz'{corpus.BASE}'")).alias("analyzed_at"),
    )
    return lifecycle.backfill_dates(docs).select("id", "published_at", "analyzed_at")


@query("with " + corpus.SQL_SUBSCRIBERS + """ select subscriber, case when subscriber % 5 = 0 then 'Dev' else array_to_string(roles, ',') end as roles, case when subscriber % 3 = 0 then false when subscriber % 5 = 0 then true else active end as active from subscribers where subscriber % 7 <> 0""")
def changed_subscribers(spark, sf_dir):
    """Some subscribers take a new role and come back, some leave by the token of their mail, some are deleted."""
    k = F.col("subscriber")
    known = corpus.subscribers(spark, sf_dir).withColumn("token", F.concat(F.lit("t"), k.cast("string")))
    changes = known.where(k % 5 == 0).select("subscriber", F.array(F.lit("Dev")).alias("roles"), F.lit(True).alias("active"))
    unknown = changes.select((k + 1_000_000_000).alias("subscriber"), "roles", "active")
    changed = lifecycle.change_subscribers(known, changes.union(unknown))
    left = lifecycle.deactivate(changed, known.where(k % 3 == 0).select("token"))
    return lifecycle.remove_subscribers(left, known.where(k % 7 == 0)).select("subscriber", F.array_join("roles", ",").alias("roles"), "active")
