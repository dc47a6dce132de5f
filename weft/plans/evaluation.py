"""Evaluation queries against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft import vocab
from weft.operators import blocks, evaluate, retrieval
from weft.operators.lineage import cut
from weft.plans import corpus, language
from weft.plans.corpus import items, read, sql
from weft.plans.registry import registry

QUERIES, ORACLES, query = registry()


SQL_GATE = "gate as (select i.source, l.quality = 1 as label, i.gate_score >= 0.4 as predicted from labels l join items i on i.id = l.doc_id)"
SQL_RATES = """count(*) filter (label and predicted) as tp, count(*) filter (not label and predicted) as fp, count(*) filter (label and not predicted) as fn, count(*) filter (not label and not predicted) as tn"""
SQL_METRICS = """round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0)::double, 0), 6) as accuracy, round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0), 6) as f1"""


def _gate(spark, sf_dir):
    return read(spark, sf_dir, "labels").join(items(spark, sf_dir), F.col("doc_id") == F.col("id")).select("source", (F.col("quality") == 1).alias("label"), (F.col("gate_score") >= 0.4).alias("predicted"))


@query(sql(f"select *, {SQL_METRICS} from (select {SQL_RATES} from gate)", SQL_GATE))
def gate_confusion(spark, sf_dir):
    return evaluate.confusion(_gate(spark, sf_dir))


@query(sql(f"select *, {SQL_METRICS} from (select source, {SQL_RATES} from gate group by 1)", SQL_GATE))
def gate_by_source(spark, sf_dir):
    return evaluate.confusion(_gate(spark, sf_dir), "source")


SQL_MUST = "must as (select b.item_id as qid, d.doc_id as id from benchmark b join documents d on contains(d.text, b.text))"
SQL_PLACED = "placed as materialized (select b.item_id as qid, i.id, row_number() over (partition by b.item_id order by coalesce(r.rel, 0) desc, i.id) as place from benchmark b cross join items i left join rel r on r.qid = b.item_id and r.id = i.id)"
SQL_RECALL = "recalls as (select m.qid, count(*) as n, round(count(*) filter (place <= 60) / count(*)::double, 6) as recall, round(count(*) filter (place <= 5) / count(*)::double, 6) as recall_small, max(place) as worst_rank from must m left join placed p on p.qid = m.qid and p.id = m.id group by 1)"


def _must_have(spark, sf_dir):
    """(qid, id): the documents that contain a benchmark passage, found by the passage's longest inner word and checked whole."""
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    # an inner word of the passage is a whole word of any text that holds it; the longest is the rarest
    inner = F.regexp_extract_all("passage", F.lit("(?<=[ \\n])[^ \\n]+(?=[ \\n])"), F.lit(0))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    d = blocks.spread(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    w = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[^ \\n]+"), F.lit(0)))).alias("w")
    words = d.select("id", w)
    asked = cut(q.withColumn("w", longest))
    inner = asked.where("w is not null")
    if retrieval.few(inner):  # nothing moves: each text is by its words
        near = d.select("id", "text", w).join(F.broadcast(inner), "w")
    else:
        near = words.join(inner, "w").select("qid", "id", "passage").join(d, "id")
    found = near.where(F.contains("text", F.col("passage"))).select("qid", "id")
    # a passage of one or two words has no inner one: a text that holds it has a word that holds the passage's longest part, which is looked for among different words
    part = F.array_max(F.transform(F.regexp_extract_all("passage", F.lit("[^ \\n]+"), F.lit(0)), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    brief = asked.where("w is null and passage is not null").select("qid", "passage", part.alias("part"))
    if brief.isEmpty():
        return found.distinct()
    holding = words.select("w").distinct().join(retrieval.batch(brief.where("part is not null")), F.contains("w", F.col("part"))).select("w", "qid", "passage")
    short = words.join(retrieval.batch(holding), "w").select("qid", "id", "passage").distinct().join(d, "id").where(F.contains("text", F.col("passage"))).select("qid", "id")
    # a passage without any word is white space, which every text is asked for
    blank = d.join(retrieval.batch(brief.where("part is null")), F.contains("text", F.col("passage"))).select("qid", "id")
    short = short.union(blank)
    return found.union(short).distinct()


@query(sql("select qid, id from must", SQL_MUST))
def passages_contained(spark, sf_dir):
    """Documents that hold a benchmark passage, word for word."""
    return _must_have(spark, sf_dir)


def _placed(spark, sf_dir, wanted):
    """(qid, id, place) of wanted pairs (qid, id) among every item for a question, by matching terms, then id."""
    return retrieval.places(language._questions(spark, sf_dir), language._searched(spark, sf_dir), wanted)


def _recall(spark, sf_dir):
    needed = cut(_must_have(spark, sf_dir))
    return evaluate.recall(_placed(spark, sf_dir, needed), needed, vocab.INDEX_TOP)


_PARTS = (language.SQL_TERMS, language.SQL_WORDS, language.SQL_REL, SQL_MUST, SQL_PLACED, SQL_RECALL)


@query(sql("select qid, n, recall, recall_small, worst_rank from recalls", *_PARTS))
def ranking_recall(spark, sf_dir):
    return corpus.longs(_recall(spark, sf_dir), "worst_rank")


@query(sql("select qid, old, recall as new, case when old is null then 'new' when recall is null then 'gone' when recall - old < -0.01 then 'worse' when recall - old > 0.01 then 'better' else 'same' end as state from (select item_id as qid, (item_id % 3) / 2.0::double as old from benchmark where item_id % 4 <> 3) full outer join recalls using (qid)", *_PARTS))
def recall_verdicts(spark, sf_dir):
    baseline = read(spark, sf_dir, "benchmark").where("item_id % 4 != 3").select(F.col("item_id").alias("qid"), ((F.col("item_id") % 3) / 2.0).alias("recall"))
    return evaluate.verdicts(_recall(spark, sf_dir), baseline)


@query(f"with {language.SQL_ANSWERS} select aid, round(((x <= 5)::int * 2 + (y between 1 and 5)::int) / 3.0::double, 6) as precision from answers")
def citation_precision(spark, sf_dir):
    answers = language._answers(spark, sf_dir).withColumn("served", F.sequence(F.lit(1), F.lit(5)))
    return evaluate.citation_precision(answers)


@query("select doc_id % 100 as aid, round(avg(case doc_id % 4 when 0 then 1.0 when 1 then 0.5 when 2 then 0.0 end), 6) as faithfulness from documents group by 1")
def faithfulness(spark, sf_dir):
    k = F.col("doc_id")
    mark = F.element_at(F.array(F.lit("s"), F.lit(" P "), F.lit("N"), F.lit("?")), (k % 4 + 1).cast("int"))
    lines = read(spark, sf_dir, "documents").select((k % 100).alias("aid"), F.concat(F.lit("claim|"), mark, F.lit("｜why")).alias("line"))
    return evaluate.faithfulness(lines)


@query(sql("select c.id, c.term, c.n from (select id, term, count(*) as n from (select id, unnest(regexp_extract_all(lower(body), '[0-9a-zA-ZÀ-ỹ]+')) as term from items) group by all having count(*) >= 2) c join (select term from (select distinct id, unnest(regexp_extract_all(lower(body), '[0-9a-zA-ZÀ-ỹ]+')) as term from items) group by 1 having count(*) = 1) o using (term) where term not in (select unnest(regexp_extract_all(lower(title), '[0-9a-zA-ZÀ-ỹ]+')) from items)"))
def rare_identifiers(spark, sf_dir):
    """Terms that one text uses again and again and nothing else has."""
    return evaluate.rare_identifiers(items(spark, sf_dir))


@query(f"""with named as (select name, unnest(list_distinct([{corpus.sql_pick(vocab.TARGET_ROLES[:6], 'length(name)')}, {corpus.sql_pick(vocab.TARGET_ROLES[:6], 'ascii(right(name, 1))')}])) as role from (select distinct source as name from documents)),
 counts as (select role, count(*) as n from named group by 1) select t.role, coalesce(n, 0) as n_sources, case when coalesce(n, 0) = 0 then 'zero' when n < 5 then 'thin' else 'ok' end as state from (select unnest({corpus.sql_list(vocab.TARGET_ROLES)}) as role) t left join counts using (role)""")
def role_coverage(spark, sf_dir):
    name = F.col("name")
    named = read(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    roles = F.array(corpus.pick(vocab.TARGET_ROLES[:6], F.length(name)), corpus.pick(vocab.TARGET_ROLES[:6], F.ascii(F.right(name, F.lit(1)))))
    taxonomy = spark.createDataFrame([(r,) for r in vocab.TARGET_ROLES], "role string")
    return evaluate.role_coverage(named.select("name", roles.alias("target_roles")), taxonomy)


@query(sql(f"select *, {SQL_METRICS} from (select {SQL_RATES} from (select i.source, l.quality = 1 as label, i.gate_score >= 0.4 as predicted from labels l join items i on i.id = l.doc_id where i.id % 6 <> 5))"))
def gate_confusion_judged(spark, sf_dir):
    """The gate against labels, without items that passed because it failed."""
    gates = read(spark, sf_dir, "labels").join(items(spark, sf_dir), F.col("doc_id") == F.col("id")).withColumn("gate_skipped", F.col("id") % 6 == 5)
    return evaluate.confusion(evaluate.judged_only(gates).select("source", (F.col("quality") == 1).alias("label"), (F.col("gate_score") >= 0.4).alias("predicted")))
