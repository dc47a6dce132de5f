"""Intake queries: fingerprints, HTML, gates, near-duplicates, passages, budgets, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import model_json, scoring, text
from weft.operators import chunks, ingest, lifecycle, similarity
from weft.plans import corpus
from weft.plans.corpus import as_of, items, read, sql
from weft.plans.registry import registry

QUERIES, ORACLES, query = registry()


def sql_html(column: str) -> str:
    out = f"coalesce({column}, '')"
    for tag in ("script", "style", "noscript", "iframe"):
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for name, char in text.ENTITIES:
        out = f"replace({out}, '{name}', {corpus.sql_text(char)})"
    return f"substr(trim(regexp_replace({out}, '[\\s\\x{{a0}}\\x{{b}}]+', ' ', 'g')), 1, 8000)"


@query(f"select page_id, sha256(t) as text_sha256, length(t) as n_chars from (select page_id, {sql_html('html')} as t from pages)")
def page_texts(spark, sf_dir):
    """Plain text of every page, as its hash and length."""
    t = text.html_text(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(t, 256).alias("text_sha256"), F.length(t).cast("bigint").alias("n_chars"))


@query("select page_id, sha256(lower(trim(url)) || '::' || lower(trim(substr(html, 1, 40)))) as fingerprint from pages")
def page_fingerprints(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.fingerprint(F.col("url"), F.substring("html", 1, 40)).alias("fingerprint"))


SQL_OUTCOMES = f"""entries as (select page_id as position, case when page_id % 7 = 0 then page_id - 1 else page_id end as same, {sql_html('html')} as content,
 case when page_id % 9 <> 0 then timestamp '{corpus.BASE}' - to_hours(page_id * 41 % 9000) end as published_at, case when page_id % 5 = 0 then 1500 else 200 end as least from pages),
early as (select *, case when length(content) < least then 'too_short' when coalesce(published_at, timestamp '{corpus.AS_OF}') < timestamp '{corpus.AS_OF}' - interval 180 days then 'too_old' end as early from entries),
placed as (select *, row_number() over (partition by same, early is null order by position) as place from early),
outcomes as (select position, coalesce(early, case when same % 10 = 4 or place > 1 then 'known' else 'new' end) as outcome from placed)"""


def _ledger(spark, sf_dir):
    e = corpus.entries(spark, sf_dir).where(F.regexp_extract("url", "(\\d+)$", 1).cast("bigint") % 10 == 4)
    return e.select(text.fingerprint(F.col("url"), F.col("title")).alias("fingerprint"))


@query("with " + SQL_OUTCOMES + " select position, outcome from outcomes")
def intake_outcomes(spark, sf_dir):
    """Length, age and first-wins deduplication of the fetched pages against a ledger."""
    return ingest.outcomes(corpus.entries(spark, sf_dir), _ledger(spark, sf_dir), as_of()).select("position", "outcome")


@query("with " + SQL_OUTCOMES + " select outcome, count(*) as n from outcomes group by 1")
def intake_summary(spark, sf_dir):
    return ingest.summary(intake_outcomes(spark, sf_dir))


@query("select page_id, coalesce(nullif(regexp_extract(html, '(?i)<meta\\s+property=[\"'']og:image[\"'']\\s+content=[\"'']([^\"'']+)[\"'']', 1), ''), 'pic/' || page_id || '.png') as image from pages")
def page_images(spark, sf_dir):
    """Main image of every page; a picture is put in front of each page, as the tables have none."""
    html = F.concat(F.lit('<img alt=x src="pic/'), F.col("page_id").cast("string"), F.lit('.png">'), F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", text.primary_image(html).alias("image"))


@query(sql("""select id, case when trim(c) = '' then 'failed' when id % 6 <> 5 and id % 3 = 0 then 'low_signal' when confidence < 0.3 then 'failed' else 'analyzed' end as status, case when id % 6 = 5 then 0.5 else round(gate_score, 6) end as gate from (select *, case when id % 50 = 7 then ' ' else body end as c from items)"""))
def gate_routes(spark, sf_dir):
    i, k = items(spark, sf_dir), F.col("id")
    content = F.when(k % 50 == 7, " ").otherwise(F.col("body"))
    return i.select("id", scoring.gate_status(k % 3 != 0, k % 6 == 5, content, F.col("confidence")).alias("status"), scoring.gate_score(F.round("gate_score", 6), k % 6 == 5).alias("gate"))


@query("""select doc_id, case when doc_id % 4 <> 3 then doc_id % 2 = 0 end as pass, case when doc_id % 4 <> 3 then least(1.0, (doc_id % 7) / 5.0) end as score, case when doc_id % 4 <> 3 then case when doc_id % 3 = 0 then 'practical' else 'noise' end end as content_type, doc_id % 4 <> 3 as ok from documents""")
def gate_json(spark, sf_dir):
    """Answers of a model with prose around the JSON, some of it broken."""
    k = F.col("doc_id")
    kind = F.when(k % 3 == 0, "practical").otherwise("gossip")
    good = F.concat(F.lit('Sure! ```json\n{"pass": '), (k % 2 == 0).cast("string"), F.lit(', "score": '), ((k % 7) / 5.0).cast("string"), F.lit(', "content_type": "'), kind, F.lit('", "reason": "r"}\n``` done'))
    got = model_json.gate_result(F.when(k % 4 == 3, F.lit("{broken")).otherwise(good))
    return read(spark, sf_dir, "documents").select("doc_id", got["pass"].alias("pass"), got["score"].alias("score"), got["content_type"].alias("content_type"), got["ok"].alias("ok"))


def _short(spark, sf_dir):
    return items(spark, sf_dir).select("id", F.concat(F.col("title"), F.lit(" "), F.col("body")).alias("text"))


SQL_TFIDF = """t as (select id, title || ' ' || body as text from items),
tf as (select id, term, count(*) as tf from (select id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) as term from t) group by all),
df as (select term, count(*) as df from tf group by 1),
raw as (select id, term, tf * (ln((1.0::double + (select count(*) from t)) / (1.0::double + df)) + 1.0::double) as raw from tf join df using (term)),
w as materialized (select id, term, raw / sqrt(sum(raw * raw) over (partition by id)) as w from raw),
pairs as materialized (select a.id as a, b.id as b, sum(a.w * b.w) as similarity from w a join w b on a.term = b.term and a.id < b.id group by all having sum(a.w * b.w) >= 0.6)"""


@query(sql("select a, b, round(similarity, 6) as similarity from pairs where a in (select min(id) from t group by text) and b in (select min(id) from t group by text)", SQL_TFIDF))
def similar_representatives(spark, sf_dir):
    """Pairs of distinct texts, by their smallest ids, with TF-IDF cosine of 0.6 or more over title and whole text."""
    pairs = similarity.similar_representatives(_short(spark, sf_dir))
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


SQL_CLUSTERS = """reach as (select id, id as r from t union select reach.id, case when p.a = reach.r then p.b else p.a end from reach join pairs p on p.a = reach.r or p.b = reach.r),
clusters as materialized (select id, min(r) as cluster from reach group by 1)"""


def sql_recursive(body: str, *more: str) -> str:
    return sql(body, *more).replace("with ", "with recursive ", 1)


@query(sql_recursive("select id, cluster from clusters", SQL_TFIDF, SQL_CLUSTERS))
def similarity_clusters(spark, sf_dir):
    return similarity.clusters(_short(spark, sf_dir))


@query(sql_recursive(f"""select id, case when n > 1 then cluster end as cluster_id, place = 1 as is_primary, n as cluster_size, case when n <= 1 and age < 3 then 'new' when n >= 3 and age < 7 then 'rising' else 'mature' end as momentum from (
 select i.id, c.cluster, count(*) over (partition by c.cluster) as n, row_number() over (partition by c.cluster order by {corpus.sql_case('i.trust_tier', {'very_high': 0, 'high': 1, 'medium': 2, 'low': 3, 'unverified': 4}, 99)}, i.published_at asc nulls last, i.confidence desc, i.id) as place,
 date_diff('day', min(coalesce(i.published_at::date, date '2026-08-01')) over (partition by c.cluster), date '2026-08-01') as age from items i join clusters c on c.id = i.id)""", SQL_TFIDF, SQL_CLUSTERS))
def dedup_run(spark, sf_dir):
    """Clusters with their primary item, size and momentum."""
    shown = F.concat(F.col("title"), F.lit(" "), F.col("body")).alias("text")
    return similarity.dedup(items(spark, sf_dir).select("id", "trust_tier", "published_at", "confidence", shown), as_of())


_WINDOW = "substr(t, pos + 1, 2000)"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _cut(pattern: str, least: int) -> str:
    """Where the last match of a pattern in the window ends, if that is not before least."""
    reach = f"length(regexp_extract({_WINDOW}, '(?s)^(.*{pattern})', 1))"
    return f"case when {reach} >= {least} then {reach} end"


# every step cuts one window off a text; the second half is tried for paragraphs, sentences and lines, the whole for words
SQL_PASSAGES = f"""texts as (select doc_id as id, trim(text, {_SPACE}) as t from documents where length(trim(text, {_SPACE})) >= 120),
cuts as (select id, t, 0 as pos, 0 as step, null::bigint as done from texts union all
 select id, t, greatest(case when gap > 0 and back + gap <= pos + cut then back + gap else back end, pos + 1), step + 1, pos + cut from (
  select *, strpos(substr(t, back + 1), ' ') as gap from (select *, pos + greatest(cut - 300, 1) as back from (
   select id, t, pos, step, coalesce({_cut(r'\n\s*\n', 1000)}, {_cut(r'[.!?…]\s', 1000)}, {_cut(r'\n', 1000)}, {_cut(r' ', 1)}, 2000) as cut from cuts where length(t) - pos > 2400)))),
pieces as (select c.id, c.step, trim(substr(c.t, c.pos + 1, coalesce(n.done, length(c.t)) - c.pos), {_SPACE}) as piece, n.done is null as tail from cuts c left join cuts n on n.id = c.id and n.step = c.step + 1),
whole as (select * from pieces where length(piece) >= 120),
short_tail as (select id, piece from pieces where tail and length(piece) between 1 and 119)"""


@query(f"with recursive {SQL_PASSAGES} select id, ordinal, length(content) as n_chars, sha256(content) as content_sha256 from (select w.id, row_number() over (partition by w.id order by w.step) - 1 as ordinal, case when w.step = max(w.step) over (partition by w.id) and s.piece is not null then w.piece || chr(10) || s.piece else w.piece end as content from whole w left join short_tail s using (id))")
def passages(spark, sf_dir):
    """Passages of every text with their place."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    out = chunks.chunked(d).select("id", "ordinal", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_sha256"))
    return corpus.longs(out, "ordinal", "n_chars")


@query("select ts::date as day, count(*) filter (event_type = 'view') as analysed, coalesce(sum(value) filter (event_type = 'click'), 0) > 0 as any_calls, round(coalesce(sum(value) filter (event_type = 'click'), 0), 4) as calls, coalesce(count(*) filter (event_type = 'error'), 0) as searches from events group by 1")
def daily_budgets(spark, sf_dir):
    """Use of each UTC day."""
    return ingest.day_budgets(read(spark, sf_dir, "events"))


@query(sql("select id, published_at from items where id % 8 = 0 order by published_at desc nulls last, id limit 40"))
def work_queue(spark, sf_dir):
    """Pending documents within what is left of the day's budget."""
    pending = items(spark, sf_dir).withColumn("status", F.when(F.col("status") == "draft", "pending").otherwise("done"))
    return ingest.work_queue(pending, 60, 460, 500).select("id", "published_at")


@query(sql(f"select id, case when published_at < timestamp '{corpus.AS_OF}' - interval 180 days or (published_at is null and created_at < timestamp '{corpus.AS_OF}' - interval 180 days) then null else length(body) end as n_chars, case when coalesce(published_at, created_at) < timestamp '{corpus.AS_OF}' - interval 180 days then 'expired' else status end as status from items"))
def purged_documents(spark, sf_dir):
    docs = items(spark, sf_dir).select("id", "published_at", "created_at", "status", F.col("body").alias("content"))
    kept, _, _ = lifecycle.purge(docs, docs.select("id", "status"), docs.select("id"), as_of())
    return kept.select("id", F.length("content").cast("bigint").alias("n_chars"), "status")


@query(sql(f"select id from items where coalesce(published_at, created_at) >= timestamp '{corpus.AS_OF}' - interval 180 days"))
def purged_passages(spark, sf_dir):
    docs = items(spark, sf_dir).select("id", "published_at", "created_at", "status", F.col("body").alias("content"))
    return lifecycle.purge(docs, docs.select("id", "status"), docs.select("id"), as_of())[2]


@query(sql(f"select id, case id % 4 when 0 then 'analyzed' when 1 then 'pending' when 2 then 'failed' else status end as status, case when id % 4 in (0, 2) then timestamp '{corpus.AS_OF}' end as analyzed_at from items"))
def status_transitions(spark, sf_dir):
    docs = items(spark, sf_dir).select("id", "status", F.expr("cast(null as timestamp_ntz)").alias("analyzed_at"))
    changes = docs.where("id % 4 < 3").select("id", F.element_at(F.array(F.lit("analyzed"), F.lit("pending"), F.lit("failed")), (F.col("id") % 4 + 1).cast("int")).alias("new_status"))
    return lifecycle.transition(docs, changes, as_of())


@query(sql("select id, ordinal, id % 3 = 0 as fresh from items, (select unnest([0, 1]) as ordinal) where id % 3 <> 0 union all select id, 5, true from items where id % 3 = 0"))
def replaced_children(spark, sf_dir):
    i = items(spark, sf_dir).select("id")
    old = i.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal"), F.lit(False).alias("fresh"))
    return lifecycle.replace_children(old, i.where("id % 3 = 0").select("id", F.lit(5).alias("ordinal"), F.lit(True).alias("fresh")), "id")


@query("select c_custkey as id, case when c_custkey % 2 = 0 then 'new ' || c_custkey else c_name end as name, c_acctbal as balance from customer union all select s_suppkey + 1000000000 as id, s_name as name, s_acctbal as balance from supplier")
def catalog_upsert(spark, sf_dir):
    """Rows of one table put over another by key; nulls leave old values."""
    old = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    new = old.where("id % 2 = 0").select("id", F.concat(F.lit("new "), F.col("id").cast("string")).alias("name"), F.lit(None).cast("double").alias("balance"))
    more = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000000).alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return lifecycle.upsert(old, new.union(more), "id")


@query("select o_orderkey as id from orders where o_orderkey not in (select l_orderkey from lineitem where l_orderkey is not null)")
def orphans(spark, sf_dir):
    """Parents without children, nulls among the children's keys notwithstanding."""
    parents = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    children = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")).union(spark.createDataFrame([(None,)], "id long"))
    return lifecycle.orphans(parents, children)


_TAKEN = f"status = 'published' and created_at >= date_trunc('day', timestamp '{corpus.AS_OF}') - interval 7 days"


@query(sql(f"select id from items where {_TAKEN}"))
def dedup_intake(spark, sf_dir):
    """Items that a clustering run takes: published ones of the last seven days."""
    return similarity.recent(items(spark, sf_dir), as_of()).select("id")


@query(sql_recursive(f"select count(distinct case when n > 1 then cluster end) as clusters_created, coalesce(sum(case when n > 1 and place > 1 then 1 else 0 end), 0)::bigint as duplicates_marked from (select c.cluster, count(*) over (partition by c.cluster) as n, row_number() over (partition by c.cluster order by c.id) as place from clusters c)", SQL_TFIDF.replace("from items)", f"from items where {_TAKEN})", 1), SQL_CLUSTERS))
def dedup_counters(spark, sf_dir):
    """Counters of a clustering run over the items of the last seven days."""
    taken = similarity.recent(items(spark, sf_dir), as_of())
    texts = _short(spark, sf_dir)
    return similarity.counters(similarity.dedup(taken.select("id", "trust_tier", "published_at", "confidence").join(texts, "id"), as_of()))


@query(sql(f"select id, case when {_TAKEN} then null else id % 10 end as cluster_id, case when {_TAKEN} then true else id % 2 = 0 end as is_primary from items"))
def cluster_reset(spark, sf_dir):
    """Clusters undone for what a run takes, kept for the rest."""
    i = items(spark, sf_dir)
    held = i.select("id", (F.col("id") % 10).alias("cluster_id"), (F.col("id") % 2 == 0).alias("is_primary"))
    return similarity.reset(held, similarity.recent(i, as_of()))


@query(sql("""select status, count(*) as n from (select case when trim(c) = '' then 'failed' when id % 6 <> 5 and id % 3 = 0 then 'low_signal' when confidence < 0.3 then 'failed' else 'analyzed' end as status from (select *, case when id % 50 = 7 then ' ' else body end as c from items)) group by 1"""))
def analysis_counters(spark, sf_dir):
    """How many documents an analysis made, skipped and failed."""
    return ingest.status_counts(gate_routes(spark, sf_dir))
