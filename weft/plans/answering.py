"""Queries over answers, prompts' parts, page links and event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weft import vocab
from weft.functions import rendering, text
from weft.operators import answers, catalog, retrieval
from weft.operators.lineage import shared_folder
from weft.plans import corpus, language
from weft.plans.corpus import items, read, sql, sql_list
from weft.plans.registry import registry
from weft.sources import entries
from weft.streaming import streams

QUERIES, ORACLES, query = registry()


@query(f"""with {language.SQL_ANSWERS} select aid, case when aid % 5 = 0 then 'out_of_scope' when aid % 5 = 1 then 'not_found' when aid % 5 = 2 then 'insufficient' when (x <= 5) or (y between 1 and 5) then 'grounded' else 'insufficient' end as outcome,
 case when aid % 5 < 3 then 0 else (x <= 5)::int + (y between 1 and 5 and y <> x)::int end as n_citations from answers""")
def answer_outcomes(spark, sf_dir):
    """Outcome of every answer over a mapping of five numbers; three in five answers cite nothing."""
    plain = language._answers(spark, sf_dir)
    k = F.col("aid") % 5
    given = plain.withColumn("answer", F.when(k == 0, " `[[OUT]]`").when(k == 1, "Rất tiếc, CHƯA có tin nào.").when(k == 2, "Surely so.").otherwise(F.col("answer")))
    mapping = plain.select("aid", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n"), F.col("aid").alias("id"))
    return answers.resolved(given, mapping, "[[OUT]]").select("aid", "outcome", "n_citations")


@query(sql("select id, sha256(array_to_string(list_filter([trim(title), trim(nature), trim(topics[1] || ' · ' || topics[2])], lambda x: x <> ''), chr(10))) as text_sha256 from items"))
def embedding_texts(spark, sf_dir):
    shown = rendering.embedding_text(F.col("title"), F.col("nature"), F.lit(None).cast("string"), F.lit(" "), F.col("topics"))
    return items(spark, sf_dir).select("id", F.sha2(shown, 256).alias("text_sha256"))


@query(sql("select id, '[' || id || '] ' || title || ' (' || strftime(coalesce(published_at, created_at), '%d/%m/%Y') || ')' || chr(10) || '    ' || nature as line from items"))
def index_lines(spark, sf_dir):
    date = rendering.date_label(F.col("published_at"), F.col("created_at"))
    return items(spark, sf_dir).select("id", rendering.index_line(F.col("id"), F.col("title"), F.col("nature"), date).alias("line"))


@query("""select distinct page_id, case when starts_with(href, '/') then regexp_extract(url, '^[a-zA-Z]+://[^/?#]+') || href else href end as link from (select page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=["'']([^"''#]+)', 1)) as href from pages) where trim(href) <> ''""")
def page_anchors(spark, sf_dir):
    """Absolute addresses of every page's links to its own host."""
    payloads = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source"), "url", F.col("html").alias("payload"))
    return entries.links(payloads).select(F.col("source").cast("bigint").alias("page_id"), F.col("url").alias("link")).distinct()


ASIDES = ["for Data Engineer", "devops only", "security & Tech Lead please", "ai engineers"]


@query(f"with said as (select conv_id * 1000 + turn as qid, ' ' || array_to_string(regexp_extract_all(lower(text || ' ' || {corpus.sql_pick(ASIDES, 'conv_id + turn')}), '[0-9a-zA-ZÀ-ỹ]+'), ' ') || ' ' as s from conversations) select qid, array_to_string(list_filter({sql_list(vocab.ROLES)}, lambda r: contains(s, ' ' || lower(r) || ' ')), ',') as roles from said")
def mentioned_roles(spark, sf_dir):
    c = F.col("conv_id") + F.col("turn")
    said = F.concat_ws(" ", "text", corpus.pick(ASIDES, c))
    return read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.array_join(rendering.mentioned_roles(said), ",").alias("roles"))


@query("""select user_id as request, coalesce(count(*) filter (event_type in ('purchase', 'error')) = 1 and max(event_id) filter (event_type in ('purchase', 'error')) = max(event_id), false) as hard,
 coalesce(min(event_id) filter (event_type = 'click') is null or min(event_id) filter (event_type = 'view') < min(event_id) filter (event_type = 'click'), false) as soft from events group by 1""")
def accepted_streams(spark, sf_dir):
    """Order checks of each request's events."""
    kind = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "status").when(F.col("event_type") == "click", "token").otherwise("other")
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("request"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("payload"))
    return answers.acceptance(e)


@query("select p_partkey as id, case when p_partkey % 3 = 0 then p_size * 1000 + (p_partkey % 10) * 100 when p_partkey % 3 = 1 then p_size * 1000 + 7 end as stars from part")
def star_counts(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    shown = F.when(k % 3 == 0, F.concat(F.lit(" "), size, F.lit("."), (k % 10).cast("string"), F.lit("k "))).when(k % 3 == 1, F.concat(size, F.lit(",007"))).otherwise("none")
    return read(spark, sf_dir, "part").select(k.alias("id"), text.star_count(shown).alias("stars"))


@query("select distinct sha256(event_type || '::' || user_id) as fingerprint from events")
def streamed_fingerprints(spark, sf_dir):
    """The events table read as a stream, each address and title once."""
    schema = read(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = raw.select(F.col("event_type").alias("url"), F.col("user_id").cast("string").alias("title"), F.col("ts").alias("published_at"))
    folder = f"{shared_folder(spark)}/weft-stream-{uuid.uuid4().hex}"
    return streams.drained(streams.fresh_entries(stream, F.expr("timestamp_ntz'2024-01-01'"), 3650).select("fingerprint"), folder)


@query("with " + "named as (select conv_id as qid, unnest(list_distinct([" + corpus.sql_pick(vocab.TARGET_ROLES, "conv_id + turn") + ", " + corpus.sql_pick(vocab.ROLES, "turn") + "])) as role from conversations) select distinct qid, role from named where role not in (" + ", ".join(map(corpus.sql_text, vocab.ROLES)) + ")")
def missing_roles(spark, sf_dir):
    """Roles named in a conversation that no item is for."""
    asked = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.array(corpus.pick(vocab.TARGET_ROLES, F.col("conv_id") + F.col("turn")), corpus.pick(vocab.ROLES, F.col("turn"))).alias("roles"))
    return retrieval.missing_roles(asked, items(spark, sf_dir)).distinct()


@query(sql("select qid, count(*) as matched, count(*) filter (id % 3 <> 0) as hidden from rel group by 1", language.SQL_TERMS, language.SQL_WORDS, language.SQL_REL))
def hidden_matches(spark, sf_dir):
    """Items that match a question, and those outside what is shown: every third item."""
    relevant = retrieval.relevance(language._questions(spark, sf_dir), language._searched(spark, sf_dir))
    return retrieval.hidden(relevant, relevant.where("id % 3 = 0"))


@query("select source as name, count(*) as n_items, true as has_items, row_number() over (order by count(*) desc, source) as place from documents where contains(source, '1') group by 1 qualify row_number() over (order by count(*) desc, source) <= 12")
def source_facets(spark, sf_dir):
    counts = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n_items"))
    return corpus.longs(catalog.facets(counts, "1"), "place")
