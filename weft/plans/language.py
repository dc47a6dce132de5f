"""Text and retrieval queries: terms, intents, ranks, fusion, context, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft import vocab
from weft.functions import intent, text
from weft.operators import blocks, retrieval
from weft.operators.lineage import cut
from weft.plans import corpus
from weft.plans.corpus import items, read, sql, sql_list
from weft.plans.registry import registry

QUERIES, ORACLES, query = registry()


TOKENS = "regexp_extract_all(lower({}), '[0-9a-zA-ZÀ-ỹ]+')"


@query(f"select term, count(*) as n from (select unnest({TOKENS.format('text')}) as term from documents) group by 1")
def term_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("select lang, cast(sum(n) as bigint) as sentences from (select lang, 1 + len(regexp_extract_all(text, '[.!?…]\\s')) as n from documents) group by 1")
def sentence_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("lang", F.size(text.sentences(F.col("text"))).alias("n")).groupBy("lang").agg(F.sum("n").alias("sentences"))


SQL_TERMS = f"terms as (select item_id as qid, unnest(list_distinct(list_filter({TOKENS.format('text')}, lambda t: length(t) >= 2 and not list_contains({sql_list(vocab.STOPWORDS)}, t)))) as term from benchmark)"
SQL_WORDS = f"words as (select id, unnest(list_distinct({TOKENS.format('''title || ' ' || event_type || ' ' || array_to_string(topics, ' ') || ' ' || body''')})) as term from items)"
SQL_REL = "rel as materialized (select qid, id, count(*) as rel from terms join words using (term) group by all)"


def _questions(spark, sf_dir):
    """Benchmark passages as questions; their vector is that of the same number."""
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return q.join(v, "qid", "left")


def _searched(spark, sf_dir):
    """Items with the words of what is searched: title, type, topics and whole text."""
    shown = F.concat_ws(" ", "title", "event_type", F.array_join("topics", " "), "body")
    return blocks.spread(items(spark, sf_dir)).withColumn("words", F.array_distinct(text.tokens(shown)))


@query(sql("select qid, id, rel from rel", SQL_TERMS, SQL_WORDS, SQL_REL))
def lexical_relevance(spark, sf_dir):
    return retrieval.relevance(_questions(spark, sf_dir), _searched(spark, sf_dir))


COSINE = "round(list_dot_product(q.embedding::double[], e.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]))), 6)"
SQL_VEC = f"vec as materialized (select b.item_id as qid, e.vec_id as id, {COSINE} as similarity from benchmark b join embeddings q on q.vec_id = b.item_id, embeddings e)"


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"))


@query(f"with {SQL_VEC} select qid, id, similarity, rank() over (partition by qid order by similarity desc) as rank from vec")
def vector_ranks(spark, sf_dir):
    return corpus.longs(retrieval.vector_ranks(_questions(spark, sf_dir), _vectors(spark, sf_dir)).select("qid", "id", "similarity", "rank"), "rank")


SQL_PASSAGES = f"""near as (select b.item_id as qid, e.vec_id as chunk_id, e.vec_id % 97 as id, round(1 - list_dot_product(q.embedding::double[], e.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]))), 6) as distance
 from benchmark b join embeddings q on q.vec_id = b.item_id, embeddings e where e.vec_id % 10 <> 9),
best as materialized (select qid, id, min(place) as chunk_rank from (select qid, id, row_number() over (partition by qid order by distance, chunk_id) as place from near) where place <= 300 group by all)"""


def _chunks(spark, sf_dir):
    """Vectors as passages of 97 items; a tenth have no item."""
    k = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(k.alias("chunk_id"), F.when(k % 10 != 9, k % 97).alias("id"), F.col("embedding").alias("emb"))


@query(f"with {SQL_PASSAGES} select qid, id, chunk_rank from best")
def passage_ranks(spark, sf_dir):
    return corpus.longs(retrieval.passage_ranks(_questions(spark, sf_dir), _chunks(spark, sf_dir)), "chunk_rank")


def _known(spark, sf_dir):
    return _searched(spark, sf_dir).join(_vectors(spark, sf_dir), "id", "left").withColumn("importance", F.struct("score", (-F.col("id")).alias("n")))


def _ranked(spark, sf_dir):
    return retrieval.hybrid(_questions(spark, sf_dir), _known(spark, sf_dir), _chunks(spark, sf_dir))


SQL_HYBRID = f"""active as (select distinct qid from terms),
base as (select b.item_id as qid, i.id, i.score, coalesce(r.rel, 0) as rel from benchmark b cross join items i left join rel r on r.qid = b.item_id and r.id = i.id),
lex as (select *, rank() over (partition by qid order by rel desc) as rank_lex from base),
vr as (select qid, id, rank() over (partition by qid order by similarity desc) as rank_vec from vec where id in (select doc_id from documents) and qid in (select qid from active)),
joined as (select l.*, v.rank_vec, c.chunk_rank, count(c.chunk_rank) over (partition by l.qid) > 0 as has_chunks from lex l left join vr v using (qid, id) left join (select * from best where qid in (select qid from active)) c using (qid, id)),
fused as (select *, round(1.0::double / (60 + rank_lex) + 1.0::double / (60 + coalesce(rank_vec, rank_lex)) + case when has_chunks then 1.0::double / (60 + coalesce(chunk_rank, rank_vec, rank_lex)) else 0 end, 9) as rrf from joined),
ranked as materialized (select qid, id, rank_lex, rank_vec, chunk_rank, rrf, row_number() over (partition by qid order by rrf desc, score desc, id) as place from fused)"""


@query(sql("select qid, id, rank_lex, rank_vec, chunk_rank, rrf, place from ranked", SQL_TERMS, SQL_WORDS, SQL_REL, SQL_VEC, SQL_PASSAGES, SQL_HYBRID))
def hybrid_ranks(spark, sf_dir):
    """Reciprocal rank fusion of lexical, vector and passage ranks of every item for every question."""
    return corpus.longs(_ranked(spark, sf_dir), "rank_lex", "rank_vec", "chunk_rank", "place")


@query(sql("select qid, id, rank_lex, rank_vec, chunk_rank, rrf, place from ranked where place <= 60", SQL_TERMS, SQL_WORDS, SQL_REL, SQL_VEC, SQL_PASSAGES, SQL_HYBRID))
def top_ranks(spark, sf_dir):
    """The sixty items shown for every question, by fused ranks."""
    return corpus.longs(_ranked(spark, sf_dir).where(F.col("place") <= vocab.INDEX_TOP), "rank_lex", "rank_vec", "chunk_rank", "place")


@query(f"with {SQL_PASSAGES} select qid, min(id) as id from best where chunk_rank = 1 group by 1 having count(*) = 1")
def best_passages(spark, sf_dir):
    return retrieval.best_passage(retrieval.passage_ranks(_questions(spark, sf_dir), _chunks(spark, sf_dir)))


def _history(spark, sf_dir):
    """Every turn of a conversation cites three items; some citations have no id."""
    c, t = F.col("conv_id"), F.col("turn")
    cites = F.array((c + t) % 50, F.when((c + t) % 3 != 0, (c * 7 + t) % 50), (c * 3 + t * 5) % 50)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", cites.cast("array<bigint>").alias("citations"))


SQL_PINS = """cited as (select conv_id, turn, unnest(c) as id, unnest(range(len(c))) as layer from (select conv_id, turn, list_filter([(conv_id + turn) % 50, case when (conv_id + turn) % 3 <> 0 then (conv_id * 7 + turn) % 50 end, (conv_id * 3 + turn * 5) % 50], lambda x: x is not null) as c from conversations)),
firsts as (select *, row_number() over (partition by conv_id, id order by layer, turn desc) as seen from cited),
pins as materialized (select conv_id, id, row_number() over (partition by conv_id order by layer, turn desc) as place from firsts where seen = 1)"""


@query(f"with {SQL_PINS} select conv_id, id, place from pins where place <= 3")
def history_pins(spark, sf_dir):
    return corpus.longs(retrieval.pins(_history(spark, sf_dir)), "place")


SQL_CONTEXT = """nearest as (select qid, min(id) as id from best where chunk_rank = 1 group by 1 having count(*) = 1),
offered as (select item_id as qid, item_id as id, 0 as section, 1 as place from benchmark union all select qid, id, 1, place from ranked join nearest using (qid, id) union all select qid, id, 2, place from ranked),
deep as materialized (select * from (select qid, id, row_number() over (partition by qid order by section, place) as o from (select *, row_number() over (partition by qid, id order by section) as seen from offered) where seen = 1) where o <= 3),
room as (select qid, 60 - count(*) as room from deep group by 1),
shown as materialized (select * from (select r.qid, r.id, row_number() over (partition by r.qid order by r.place) as o, room from ranked r join room using (qid) where not exists (select 1 from deep d where d.qid = r.qid and d.id = r.id)) where o <= room),
kept_pins as materialized (select * from (select p.conv_id as qid, p.id, row_number() over (partition by p.conv_id order by p.place) as o, room from pins p join room on room.qid = p.conv_id
 where p.place <= 3 and not exists (select 1 from deep d where d.qid = p.conv_id and d.id = p.id) and not exists (select 1 from shown s where s.qid = p.conv_id and s.id = p.id)) where o <= room),
numbered as (select qid, id, 0 as part, o, 'deep' as depth from deep
 union all select s.qid, s.id, 1, s.o, 'index' from shown s left join (select qid, count(*) as n from kept_pins group by 1) k using (qid) where s.o <= room - coalesce(n, 0)
 union all select qid, id, 2, o, 'index' from kept_pins)"""


@query(sql("select qid, id, row_number() over (partition by qid order by part, o) as n, depth from numbered", SQL_TERMS, SQL_WORDS, SQL_REL, SQL_VEC, SQL_PASSAGES, SQL_HYBRID, SQL_PINS, SQL_CONTEXT))
def answer_context(spark, sf_dir):
    """Numbered context of every question: its own item, that of its best passage and ranked ones deep, an index, pins of the conversation of its number."""
    q = read(spark, sf_dir, "benchmark")
    refs = q.select(F.col("item_id").alias("qid"), F.col("item_id").alias("id"), F.lit(1).alias("place"))
    pinned = retrieval.pins(_history(spark, sf_dir)).withColumnRenamed("conv_id", "qid").join(q.select(F.col("item_id").alias("qid")), "qid", "left_semi")
    asked, known, chunks = _questions(spark, sf_dir), _known(spark, sf_dir), _chunks(spark, sf_dir)
    passages = cut(retrieval.passage_ranks(asked, chunks))
    best = retrieval.best_passage(passages).join(known.select("id"), "id", "left_semi")
    ranked = cut(retrieval.hybrid(asked, known, chunks, passages=passages).where(F.col("place") <= vocab.INDEX_TOP).select("qid", "id", "place"))
    return corpus.longs(retrieval.context(ranked, refs, pinned, best, best_known=True), "n")


def _answers(spark, sf_dir):
    k = F.col("doc_id")
    n = lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))
    return read(spark, sf_dir, "documents").select(k.alias("aid"), F.concat(F.lit("See "), n(k % 7 + 1), F.lit(" and "), n(k % 4), F.lit(" , again "), n(k % 7 + 1), F.lit(" .")).alias("answer"))


SQL_ANSWERS = "answers as (select doc_id as aid, doc_id % 7 + 1 as x, doc_id % 4 as y from documents)"


@query(f"with {SQL_ANSWERS} select *, case when n = 5 then 'web' else 'insight' end as kind from (select aid, x as n, aid * 10 + x as id, 1 as place from answers where x <= 5 union all select aid, y, aid * 10 + y, case when x <= 5 then 2 else 1 end from answers where y between 1 and 5 and y <> x)")
def answer_citations(spark, sf_dir):
    """Markers resolved over a mapping of five numbers."""
    answers = _answers(spark, sf_dir)
    mapping = answers.select("aid", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n")).withColumn("id", F.col("aid") * 10 + F.col("n"))
    mapping = mapping.withColumn("kind", F.when(F.col("n") == 5, "web").otherwise("insight"))
    return corpus.longs(retrieval.citations(answers, mapping), "n")


@query(f"with {SQL_ANSWERS} select aid, trim(regexp_replace(regexp_replace(replace(replace('See [' || x || '] and [' || y || '] , again [' || x || '] .', case when x > 5 then '[' || x || ']' else '#' end, ''), case when y < 1 then '[' || y || ']' else '#' end, ''), ' +([.,;:!?])', '\\1', 'g'), ' {{2,}}', ' ', 'g')) as answer from answers")
def cleaned_answers(spark, sf_dir):
    """Answers without the markers that have no source."""
    mapped = F.sequence(F.lit(1), F.lit(5))
    return _answers(spark, sf_dir).select("aid", text.without_unmapped(F.col("answer"), mapped).alias("answer"))


GREETINGS = ["xin chào bạn", "cảm ơn nhé", "bạn làm được gì", "giới thiệu đi", "nó là ai", "công cụ này hỗ trợ gì", "bot này dùng để làm gì", "OpenSSL là gì", "", "hello bot", "trợ lý hoạt động thế nào"]
_WORDS = TOKENS.format("q")
_IN = lambda some: f"list_has_any(w, {sql_list(some)})"
_ANY = lambda some: f"regexp_matches(j, '{'|'.join(some)}')"


@query(f"""with asked as (select conv_id * 1000 + turn as qid, case when (conv_id + turn) % 2 = 0 then text else {corpus.sql_pick(GREETINGS, 'conv_id + turn')} end as q from conversations),
split as (select qid, {_WORDS} as w from asked), parts as (select *, array_to_string(w, ' ') as j, list_filter(w, lambda t: not list_contains({sql_list([*intent.INTENT_WORDS, *vocab.STOPWORDS])}, t)) as r from split),
flags as (select *, {_ANY(vocab.CAPABILITY_PHRASES)} as cap, ({_IN(vocab.SELF_WORDS)} or {_ANY(vocab.SELF_PHRASES)}) as own, {_IN(vocab.ANAPHORA)} as pointed, len(list_filter(r, lambda t: not list_contains({sql_list(intent.CAPABILITY_WORDS)}, t))) > 0 as leftover from parts)
select qid, case when len(w) = 0 then null when len(r) > 0 then case when not cap or (pointed and not own) or (leftover and not own) then null when not leftover and own then 'capability' else 'ambiguous' end
 when cap and pointed and not own then null when cap and own then 'capability' when cap then 'ambiguous' when {_IN(vocab.THANKS)} then 'thanks' when {_IN(vocab.SALUTATIONS)} then 'salutation' end as route from flags""")
def intents(spark, sf_dir):
    """Route of every conversation turn, half of them replaced by set phrases."""
    c = F.col("conv_id") + F.col("turn")
    asked = F.when(c % 2 == 0, F.col("text")).otherwise(corpus.pick(GREETINGS, c))
    return read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), intent.route(asked).alias("route"))


@query("select conv_id, count(*) as turns, min(turn) as first_turn from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 10 group by 1")
def history_tail(spark, sf_dir):
    """The last ten turns of each conversation."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    tail = F.slice("turns", F.greatest(F.size("turns") - 9, F.lit(1)), 10)
    return turns.select("conv_id", F.size(tail).cast("bigint").alias("turns"), tail[0].alias("first_turn"))


@query("select item_id, case when length(text) <= 60 then text else regexp_replace(substr(text, 1, 60), ' [^ ]*$', '') || '…' end as shown from benchmark")
def shortened(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", text.shortened(F.col("text"), 60).alias("shown"))


@query("select c_custkey as id, substr(a, 1, 2) || '***@' || split_part(a, '@', 2) as masked from (select c_custkey, lower(replace(c_name, '#', '.')) || '@x.example' as a from customer)")
def masked_emails(spark, sf_dir):
    address = text.email(F.concat(F.lit(" "), F.replace(F.col("c_name"), F.lit("#"), F.lit(".")), F.lit("@X.example ")))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.masked_email(address).alias("masked"))
