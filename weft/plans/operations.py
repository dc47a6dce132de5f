"""Queries over streams of calls and fetches, inserts, the evaluation harness and web sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weft import vocab
from weft.functions import scoring
from weft.operators import digest, evaluate, lifecycle, retrieval
from weft.operators.lineage import cut, shared_folder
from weft.plans import corpus, evaluation, intake, language, selection
from weft.plans.corpus import read, sql
from weft.plans.registry import registry
from weft.sources import fetch, sinks
from weft.streaming import streams

QUERIES, ORACLES, query = registry()


def _events(spark, sf_dir):
    """The events table as a stream."""
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/weft-stream-{uuid.uuid4().hex}"


@query("select user_id as request, row_number() over (partition by user_id order by event_id) - 1 as n, event_type as kind, props as data from events")
def parsed_frames(spark, sf_dir):
    """A frame for each event, cut in two anywhere, parsed again from each user's pieces."""
    frame = F.concat(F.lit("event: "), "event_type", F.lit("\ndata: "), "props", F.lit("\n\n"))
    cut = (F.col("event_id") * 7 % F.length("frame")).cast("int")
    halves = F.array(F.struct((F.col("event_id") * 2).alias("seq"), F.left("frame", cut).alias("piece")), F.struct((F.col("event_id") * 2 + 1).alias("seq"), F.substr("frame", cut + 1).alias("piece")))
    pieces = _events(spark, sf_dir).withColumn("frame", frame).select(F.col("user_id").alias("request"), F.explode(halves).alias("x")).select("request", "x.*")
    return streams.drained(streams.frames(pieces), _folder(spark))


@query("""with r as (select user_id as source, event_id as seq, event_type in ('purchase', 'signup') as ok, sum((event_type in ('purchase', 'signup'))::int) over (partition by user_id order by event_id) as g from events),
k as (select *, count(*) filter (not ok) over (partition by source, g order by seq) as bad, coalesce(lag(g) over (partition by source order by seq), 0) as before from r),
ends as (select source, g, count(*) filter (not ok) as bads from r group by all),
a as (select k.source, k.seq, k.ok, case when ok then 1 + coalesce(e.bads, 0) % 3 else (bad - 1) % 3 + 1 end as attempt from k left join ends e on e.source = k.source and e.g = k.g - 1)
select source, seq, attempt, case when ok then 'done' when attempt = 3 then 'failed' else 'retry' end as state,
 case when not ok and attempt < 3 then round(2.0::double * pow(2, attempt - 1) + ('0x' || substr(md5(source || ':' || attempt), 1, 8))::bigint / 4294967296.0::double, 6) end as wait from a""")
def fetch_attempts(spark, sf_dir):
    """Attempts, outcomes and waits of each source, from a stream of results."""
    results = _events(spark, sf_dir).select(F.col("user_id").alias("source"), F.col("event_id").alias("seq"), F.col("event_type").isin("purchase", "signup").alias("ok"))
    return streams.drained(streams.attempts(results), _folder(spark))


@query("""with b as (select event_id // 3 as request, ts as began_at from events where event_id % 3 = 0), f as (select event_id // 3 as request, ts as ended_at from events where event_id % 3 = 1 and event_type <> 'error'),
w as (select least((select max(began_at) from b), (select max(ended_at) from f)) - interval 1 hour as seen),
m as (select b.request, began_at, f.request is not null as ended from b left join f on f.request = b.request and ended_at between began_at and began_at + interval 5 minutes)
select request, began_at, case when ended then 'finished' else 'aborted' end as state from m, w where ended or began_at + interval 5 minutes < seen""")
def call_states(spark, sf_dir):
    """Which calls ended and which were aborted, as far as two streams can tell."""
    e, k = _events(spark, sf_dir), F.col("event_id")
    begun = e.where(k % 3 == 0).select(F.floor(k / 3).alias("request"), "ts")
    finished = e.where((k % 3 == 1) & (F.col("event_type") != "error")).select(F.floor(k / 3).alias("request"), "ts")
    out = streams.drained(streams.call_outcomes(begun, finished, "5 minutes", "1 hour"), _folder(spark))
    return out.withColumn("began_at", F.col("began_at").cast("timestamp_ntz"))


@query("select distinct sha256(event_type || '::' || user_id) as fingerprint from events")
def ledger_of_events(spark, sf_dir):
    """Fingerprints of the events in a ledger after a stream has been recorded, and one batch of it again."""
    folder = _folder(spark)
    stream = _events(spark, sf_dir).select(F.col("event_type").alias("url"), F.col("user_id").cast("string").alias("title"), F.col("ts").alias("published_at"))
    marked = streams.fresh_entries(stream, F.expr("timestamp_ntz'2024-01-01'"), 3650).select("fingerprint")
    streams.into_ledger(marked, f"{folder}/ledger", folder).awaitTermination()
    known = spark.read.schema(streams.LEDGER).parquet(f"{folder}/ledger")
    streams.record(known.select("fingerprint"), 1_000_000, f"{folder}/ledger")
    return spark.read.schema(streams.LEDGER).parquet(f"{folder}/ledger").select("fingerprint")


@query("select doc_id as id, case when doc_id % 3 <> 0 then lang else 'first' end as label from documents")
def inserted_documents(spark, sf_dir):
    """A table without every third document, and two rows for each document to insert: known keys stay, new ones come once."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    rows = d.select("id", F.explode(F.array(F.lit("first"), F.lit("second"))).alias("label"))
    return lifecycle.insert_new(d.where("id % 3 != 0"), rows, "id", "label")


def _literal_resolve(method: str, uri: str, seconds: float) -> str:
    """A client without a network: the kind before the colon says how it answers, the page stands after it."""
    kind, _, page = uri.partition(":")
    if kind == "gone" or (kind == "get" and method == "HEAD"):
        raise ConnectionError(kind)
    return f"{'bad' if kind == 'bad' else 'data'}:{page}"


def _literal_fetch(url: str, seconds: float):
    kind, _, page = url.partition(":")
    if kind == "bad":
        raise ValueError(kind)
    data = page.encode()
    yield from (data[at : at + 1000] for at in range(0, len(data), 1000))


_TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"


@query(f"""with p as (select page_id, page_id // 4 as request, page_id % 4 as spot, coalesce(html, '') as html from pages),
w as (select *, row_number() over (partition by request order by spot) as n from p where page_id % 7 <> 6),
t as (select request, spot, {intake.sql_html(r"regexp_replace(html, '(?is)<title\b[^>]*>.*?</title\s*>', ' ', 'g')")} as text, substr({intake.sql_html(f"regexp_extract(html, '{_TITLE}', 1)")}, 1, 300) as title from w where n <= 3 and page_id % 5 not in (0, 2))
select request, row_number() over (partition by request order by spot) as place, title, sha256(text) as text_sha256 from t where text <> ''""")
def web_sources(spark, sf_dir):
    """Sources of requests of four addresses each, fetched from literal pages: some are empty, some redirect, some are gone or fail."""
    k = F.col("page_id")
    kind = F.when(k % 5 == 0, "gone").when(k % 5 == 1, "get").when(k % 5 == 2, "bad").otherwise("ok")
    requests = read(spark, sf_dir, "pages").select(F.floor(k / 4).alias("request"), (k % 4).alias("place"), F.when(k % 7 != 6, F.concat(kind, F.lit(":"), F.coalesce("html", F.lit("")))).alias("uri"))
    sources = fetch.web_sources(fetch.fetched(requests, _literal_resolve, _literal_fetch, seconds=60.0))
    return corpus.longs(sources.select("request", "place", "title", F.sha2("text", 256).alias("text_sha256")), "place")


@query(sql("""select case when grouping(grp) = 1 then 'overall' when grouping(qid) = 1 then 'group' else 'question' end as level, grp, qid, count(*) as n, round(avg(recall), 6) as recall, round(avg(recall_small), 6) as recall_small, max(worst_rank) as worst_rank
 from (select *, qid % 3 as grp from recalls) group by rollup (grp, qid)""", language.SQL_TERMS, language.SQL_WORDS, language.SQL_REL, evaluation.SQL_MUST, evaluation.SQL_PLACED, evaluation.SQL_RECALL))
def recall_levels(spark, sf_dir):
    """Recall overall, by group of questions and by question."""
    return evaluate.recall_levels(evaluation.ranking_recall(spark, sf_dir).withColumn("grp", F.col("qid") % 3))


@query(sql("select m.qid, m.id, place from must m left join placed p using (qid, id) where place is null or place > 60", language.SQL_TERMS, language.SQL_WORDS, language.SQL_REL, evaluation.SQL_MUST, evaluation.SQL_PLACED))
def ranking_misses(spark, sf_dir):
    """Needed items beyond the first sixty, with the place that they have."""
    needed = cut(evaluation._must_have(spark, sf_dir))
    return corpus.longs(evaluate.misses(evaluation._placed(spark, sf_dir, needed), needed, 60), "place")


@query(sql("""select id, case when id % 5 = 1 then 'new' when id % 5 = 2 then 'gone' when now = label and was <> label then 'fixed' when now <> label and was = label then 'broken' when now = label then 'right' else 'wrong' end as state
 from (select i.id, l.quality = 1 as label, i.gate_score >= 0.4 as now, i.gate_score >= 0.6 as was from labels l join items i on i.id = l.doc_id)"""))
def gate_flips(spark, sf_dir):
    """Verdicts of a gate against those of a frozen one."""
    judged = read(spark, sf_dir, "labels").join(corpus.items(spark, sf_dir), F.col("doc_id") == F.col("id")).select("id", (F.col("quality") == 1).alias("label"), "gate_score")
    at = lambda least, out: judged.where(F.col("id") % 5 != out).select("id", "label", (F.col("gate_score") >= least).alias("predicted"))
    return evaluate.flips(at(0.4, 2), at(0.6, 1))


@query("""select count(*) as n, round(avg(case when doc_id % 4 <> 0 then (doc_id % 11) / 10.0::double end), 6) as relevance, round(avg(((doc_id % 6 = 0) <> (doc_id % 5 <> 0))::int), 6) as refusals_right,
 round(avg(case when doc_id % 3 <> 0 then (doc_id % 7 in (doc_id % 4, 1))::int end), 6) as must_have_hit from documents""")
def answer_report(spark, sf_dir):
    """Means over answers, one for each document."""
    k = F.col("doc_id")
    return evaluate.answer_report(read(spark, sf_dir, "documents").select(
        F.when(k % 4 != 0, (k % 11) / 10.0).alias("relevance"), (k % 6 == 0).alias("refused"), (k % 5 != 0).alias("answerable"),
        F.array(k % 4, F.lit(1).cast("bigint")).alias("cited"), F.when(k % 3 != 0, F.array(k % 7)).alias("must_have"),
    ))


@query(sql("select qid, id, rel from rel where qid <> id", language.SQL_TERMS, language.SQL_WORDS, language.SQL_REL))
def beside_anchor(spark, sf_dir):
    """Items that match a question, without the question's own."""
    matched = retrieval.relevance(language._questions(spark, sf_dir), language._searched(spark, sf_dir))
    return retrieval.beside(matched, read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("item_id").alias("id")))


_ASKED = "case when id % 4 = 0 then [] when id % 4 = 1 then [rec_role, 'nobody'] else [" + corpus.sql_pick(vocab.ROLES, "id * 3") + "] end"
_KEY = ["a", "b", "c", "d", "e", "f", "g"]


@query(sql(f"""select id, {", ".join(f"{k}::double as {k}" for k in _KEY)} from (select *, row_number() over (partition by id order by a desc, b desc, c desc, d desc, e desc, f desc, g desc) as o from (
 select id, {selection.URGENCY} as a, {corpus.sql_case('impact_label', vocab.IMPACT_RANK, 0)} as b, practical::int as c, score as d, (tier = 'Strategic')::int as e, trust_score as f, epoch(coalesce(published_at, created_at)) as g
 from (select *, unnest(case when len(asked) > 0 then asked else roles end) as role from (select *, {_ASKED} as asked from items)))) where o = 1"""))
def importance_over_roles(spark, sf_dir):
    """The seven-part key of every item, the largest over the roles asked for, or those it affects."""
    k = F.col("id")
    i = corpus.items(spark, sf_dir)
    named = F.array(F.when(k % 4 != 0, corpus.pick(vocab.ROLES, k)), F.lit("nobody"))
    asked = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, named).otherwise(F.array(corpus.pick(vocab.ROLES, k * 3)))
    return i.select("id", scoring.importance_over(F.col, asked).alias("key")).select("id", *[F.col(f"key.{c}").cast("double").alias(c) for c in _KEY])


_AS_OF = f"timestamp '{corpus.AS_OF}'"
_BRIEF = selection.SQL_DIGEST.replace("where status = 'published' and is_primary)", f"where status = 'published' and is_primary and created_at >= {_AS_OF} - interval 1000 hours)").replace(
    "from subscribers where active", f"from subscribers s where not exists (select 1 from deliveries d where d.subscriber = s.subscriber and d.sent_at > {_AS_OF} - interval 48 hours) and active")


@query(sql("select subscriber, id, role, place, section, overflow from chosen", corpus.SQL_SUBSCRIBERS, corpus.SQL_DELIVERIES, _BRIEF))
def brief_run(spark, sf_dir):
    """One run of a brief: rested subscribers, items of the last thousand hours."""
    chosen = digest.brief(corpus.subscribers(spark, sf_dir), corpus.items(spark, sf_dir), corpus.deliveries(spark, sf_dir), corpus.as_of(), 1000)
    return corpus.longs(chosen, "place", "section")


@query(sql("select (select count(*) from (select distinct subscriber from chosen) where subscriber % 3 <> 0) as sent, (select count(*) from (select distinct subscriber from chosen) where subscriber % 3 = 0) as failed, (select count(*) from (select distinct subscriber from subscribers where active and len(roles) > 0) p where subscriber not in (select subscriber from chosen)) as skipped", corpus.SQL_SUBSCRIBERS, corpus.SQL_DELIVERIES, _BRIEF))
def brief_counts(spark, sf_dir):
    """How many digests of a run were sent, failed and skipped."""
    people = corpus.subscribers(spark, sf_dir)
    return digest.run_counts(people, brief_run(spark, sf_dir), people.select("subscriber", (F.col("subscriber") % 3 != 0).alias("ok")))


@query("select d.doc_id as id, d.lang, e.vec_id is not null as has_vector, round(list_sum(list_transform(e.embedding, lambda x: round(x::double, 6))), 4) as vector_sum from documents d left join embeddings e on e.vec_id = d.doc_id")
def published_corpus(spark, sf_dir):
    """Documents and vectors written as one version of a fixture and read back."""
    path = _folder(spark)
    sinks.publish({"corpus": read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "vectors": read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")}, path)
    back = sinks.published(spark, path)
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4)
    return back["corpus"].join(back["vectors"], "id", "left").select("id", "lang", F.col("embedding").isNotNull().alias("has_vector"), total.alias("vector_sum"))
