"""Ranking of items for batches of questions: lexical, vector and passage ranks, their fusion, and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft import vocab
from weft.functions import text, vectors
from weft.operators import blocks
from weft.operators.lineage import cut


#: Rows of a batch of questions that are broadcast; a larger batch is left to the planner.
BROADCAST_ROWS = 10_000
#: Passages of a batch of questions that are broadcast.
BROADCAST_PASSAGES = 1_000_000
#: Items that each list of top() takes for a question; well over the items shown and the passages of a question together.
LIST = 512
#: Steps of a binary search among a question's candidates: three lists and the passages make no more than 2,047.
STEPS = [1 << k for k in range(10, -1, -1)]


def few(questions: DataFrame) -> bool:
    return questions.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def batch(questions: DataFrame) -> DataFrame:
    """A batch of questions, broadcast where a check of its size allows it."""
    return F.broadcast(questions) if few(questions) else questions


def _terms(questions: DataFrame) -> DataFrame:
    return questions.withColumn("terms", F.array_distinct(text.question_terms(F.col("text"))))


def relevance(questions: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, id, rel) where rel > 0: distinct question terms among the words of an item. questions (qid, text), items (id, words)."""
    asked = _terms(questions).withColumn("least", F.lit(1))
    met = blocks.pairs(asked, items.select("id", "words"), few(questions.select("qid")), words=True)
    return met.groupBy("qid", "id").agg(F.sum("rel").alias("rel"))


def places(questions: DataFrame, items: DataFrame, wanted: DataFrame) -> DataFrame:
    """(qid, id, place) of the wanted pairs (qid, id) among all items of a question, by matching terms, then id.

    An item with fewer matching terms than the last wanted one of its question is before none of them, so only the others are
    sorted: few where wanted items match well, and all, unmatched ones too, where one matches nothing.
    """
    asked, small, plain = _terms(questions), few(questions.select("qid")), items.select("id", "words")
    own = blocks.pairs(asked, plain.join(wanted.select("id").distinct(), "id", "left_semi"), small, words=True)
    least = cut(own.join(wanted, ["qid", "id"], "left_semi").groupBy("qid").agg(F.min("rel").alias("least")))
    met = blocks.pairs(asked.join(least, "qid"), plain, small, words=True)
    placed = met.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "id")))
    return placed.join(wanted, ["qid", "id"], "left_semi").select("qid", "id", "place")


RANKED = ("qid", "id", "rank_lex", "rank_vec", "chunk_rank", "rrf", "place")


def _similarity():
    """Cosine of qvec and emb, rounded as vector_ranks() does."""
    size = vectors.norm(F.col("emb")) * vectors.norm(F.col("qvec"))
    return F.round(F.when(size == 0, 0.0).otherwise(vectors.dot(F.col("qvec"), F.col("emb")) / size), 6)


def _measured(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """Every pair of a question with a vector and a row with one, with their cosine: (qid, similarity, ...) and the row's columns but emb."""
    asked = questions.where("qvec is not null").select("qid", "qvec")
    return blocks.pairs(asked, rows.where("emb is not null"), few(asked.select("qid")), emb=True).drop("measured")


def vector_ranks(questions: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, id, similarity, rank): competition rank by cosine of items with a vector. questions (qid, qvec) meet all items."""
    met = _measured(questions, items).select("qid", "id", F.round("similarity", 6).alias("similarity"))
    return met.withColumn("rank", F.rank().over(Window.partitionBy("qid").orderBy(F.desc("similarity"))))


def passage_ranks(questions: DataFrame, chunks: DataFrame, limit: int = vocab.PASSAGES) -> DataFrame:
    """(qid, id, chunk_rank): best place of each item's passages among the limit nearest of a question. chunks (chunk_id, id, emb)."""
    met = _measured(questions, chunks.where("id is not null")).select("qid", "id", "chunk_id", F.round(1 - F.col("similarity"), 6).alias("distance"))
    placed = met.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "chunk_id"))).where(F.col("place") <= limit)
    return placed.groupBy("qid", "id").agg(F.min("place").alias("chunk_rank"))


def hybrid(questions: DataFrame, items: DataFrame, chunks: DataFrame, limit: int = vocab.PASSAGES, passages: DataFrame | None = None) -> DataFrame:
    """(qid, id, rank_lex, rank_vec, chunk_rank, rrf, place): reciprocal rank fusion with the rules for missing signals.

    questions (qid, text, qvec), items (id, words, emb, importance), chunks (chunk_id, id, emb). A question without
    terms has no vector and no passages. An item without a vector takes its lexical rank for it; passages count
    only for questions that have any, and an item without one takes its vector rank. Ties go by importance, then id.
    passages takes passage_ranks() where they are known.
    """
    asked = _terms(questions).withColumn("qvec", F.when(F.size("terms") > 0, F.col("qvec")))
    met = blocks.pairs(asked, items.select("id", "importance", "words", "emb"), few(questions.select("qid")), words=True, emb=True)
    of, nearest = Window.partitionBy("qid"), (F.desc("measured"), F.desc(F.round("similarity", 6)))
    ranked = met.withColumn("rank_lex", F.rank().over(of.orderBy(F.desc("rel")))).withColumn("rank_vec", F.when(F.col("measured"), F.rank().over(of.orderBy(*nearest))))
    active = asked.where(F.size("terms") > 0)
    passages = cut(passage_ranks(active, chunks, limit) if passages is None else passages.join(active.select("qid"), "qid", "left_semi"))
    passages = F.broadcast(passages) if passages.count() <= BROADCAST_PASSAGES else passages
    whole = ranked.join(passages, ["qid", "id"], "left")
    ranked = whole.withColumn("rrf", _fused(F.col("rank_lex"), F.col("rank_vec"), F.col("chunk_rank"), F.count("chunk_rank").over(of) > 0))
    return ranked.withColumn("place", F.row_number().over(of.orderBy(F.desc("rrf"), F.desc("importance"), "id"))).select(*RANKED)


def _fused(lexical, vector, chunk, any_chunk):
    """Reciprocal rank fusion: a missing vector rank is the lexical one, a missing passage rank the vector one, for questions that have passages."""
    borrowed = F.coalesce(vector, lexical)
    passages = F.when(any_chunk, vectors.rrf(F.coalesce(chunk, borrowed), vocab.RRF_K)).otherwise(0.0)
    return F.round(vectors.rrf(lexical, vocab.RRF_K) + vectors.rrf(borrowed, vocab.RRF_K) + passages, 9)


def top(questions: DataFrame, items: DataFrame, chunks: DataFrame, shown: int = vocab.INDEX_TOP, size: int = LIST, passages: DataFrame | None = None, limit: int = vocab.PASSAGES) -> DataFrame:
    """The rows of hybrid() with a place of at most shown, without ranking all items of a question.

    A question's candidates are the items of its passages and the first size items by vector, by words (ties by vector), and, among
    those without a vector, by words; lists are cut within each task before they move. Competition ranks of candidates are
    exact: one by words is counted in a histogram of the few values it has, one by vector in a histogram between the candidates'
    own similarities, so all other items are only counted. An item outside the lists scores no more than a bound from the last
    ones in them; questions whose last shown item does not pass the bound are ranked whole by hybrid(). So the result is that
    of hybrid(), ties included. passages takes passage_ranks() where they are known. shown and the passage limit together
    must not exceed size.
    """
    terms = F.size(text.question_terms(F.col("text"))) > 0
    asked = cut(questions.select("qid", "text", F.when(terms, F.col("qvec")).alias("qvec"), terms.alias("active")))
    active = asked.where("active").drop("active")
    plain = items.select("id", "importance", "emb")
    rel = cut(relevance(active, items))
    near_passages = cut((passage_ranks(active, chunks, limit) if passages is None else passages).join(active.select("qid"), "qid", "left_semi").join(plain.select("id"), "id", "left_semi"))

    higher = Window.partitionBy("qid").orderBy(F.desc("rel")).rowsBetween(Window.unboundedPreceding, -1)
    by_rel = rel.groupBy("qid", "rel").agg(F.count("*").alias("n"))
    by_rel = cut(by_rel.select("qid", "rel", (1 + F.coalesce(F.sum("n").over(higher), F.lit(0))).alias("rank_lex"), (1 + F.sum("n").over(Window.partitionBy("qid").orderBy(F.desc("rel")))).alias("rank_below")))
    zero = by_rel.groupBy("qid").agg(F.max("rank_below").alias("rank_zero"))

    measured = _measured(active, plain).select("qid", "id", "importance", F.round("similarity", 6).alias("similarity"))
    held = lambda df, name, *order: df.withColumn(name, F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col(name) <= size).select("qid", "id", name)
    tail = (F.desc("importance"), F.col("id"))
    matched = rel.join(plain, "id").join(batch(active.select("qid", "qvec")), "qid")
    alike = matched.withColumn("similarity", _similarity())
    lists = [
        held(measured, "near", F.desc("similarity"), *tail),
        held(alike.where("similarity is not null"), "worded", F.desc("rel"), F.desc("similarity"), *tail),
        held(alike.where("similarity is null"), "bare", F.desc("rel"), *tail),
        near_passages.select("qid", "id"),
    ]
    # without a match, items without a vector differ by importance only, and for a question without terms or vector all items do
    first = lambda df: F.broadcast(df.orderBy(*tail).limit(size).select("id", F.lit(True).alias("any")))
    blank = F.col("active") & F.col("qvec").isNotNull()
    lists.append(asked.where(blank).withColumn("any", F.lit(True)).join(first(plain.where("emb is null")), "any").select("qid", "id"))
    lists.append(asked.where(~blank).withColumn("any", F.lit(True)).join(first(plain), "any").select("qid", "id"))
    offered = lists[0]
    for more in lists[1:]:
        offered = offered.unionByName(more, allowMissingColumns=True)
    offered = offered.groupBy("qid", "id").agg(F.max("near").alias("near"), F.max("worded").alias("worded"))
    known = cut(offered.join(plain, "id").join(batch(asked.select("qid", "qvec")), "qid").select("qid", "id", "importance", "near", "worded", _similarity().alias("similarity")))

    cuts = known.where("similarity is not null").groupBy("qid").agg(F.array_sort(F.collect_set("similarity")).alias("cuts"))
    below = lambda at, step: F.when(F.get("cuts", at + step - 1) < F.col("similarity"), at + step).otherwise(at)
    counted = measured.join(batch(cuts), "qid").select("qid", F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), below).alias("at")).groupBy("qid", "at").agg(F.count("*").alias("n"))
    every = cuts.select("qid", F.posexplode("cuts").alias("pos", "similarity")).select("qid", (F.col("pos") + 1).alias("at"), "similarity", F.lit(0).cast("long").alias("n"))
    filled = every.unionByName(counted.withColumn("similarity", F.lit(None).cast("double"))).groupBy("qid", "at").agg(F.max("similarity").alias("similarity"), F.sum("n").alias("n"))
    ranks = filled.withColumn("rank_vec", 1 + F.sum("n").over(Window.partitionBy("qid").orderBy(F.desc("at")))).where("similarity is not null").select("qid", "similarity", "rank_vec")

    whole = known.join(rel, ["qid", "id"], "left").join(by_rel, ["qid", "rel"], "left").join(zero, "qid", "left").join(ranks, ["qid", "similarity"], "left").join(near_passages, ["qid", "id"], "left")
    of = Window.partitionBy("qid")
    lexical = F.coalesce("rank_lex", "rank_zero", F.lit(1))
    scored = whole.select("qid", "id", "importance", "near", "worded", lexical.alias("rank_lex"), F.coalesce("rank_below", "rank_zero", F.lit(1)).alias("rank_below"), "rank_vec", "chunk_rank", (F.count("chunk_rank").over(of) > 0).alias("any_chunk"))
    scored = scored.withColumn("rrf", _fused(F.col("rank_lex"), F.col("rank_vec"), F.col("chunk_rank"), F.col("any_chunk")))
    placed = cut(scored.withColumn("place", F.row_number().over(of.orderBy(F.desc("rrf"), *tail))))

    last = lambda name, value: F.max(F.when(F.col(name) == size, F.col(value)))
    edge = placed.groupBy("qid").agg(
        last("near", "rank_vec").alias("vec"), last("worded", "rank_lex").alias("lex"), last("worded", "rank_below").alias("less"), last("worded", "rank_vec").alias("tied"),
        F.max("any_chunk").alias("any_chunk"), F.min(F.when(F.col("place") == shown, F.col("rrf"))).alias("least"),
    ).join(zero, "qid", "left")
    none = F.lit(None).cast("long")
    # of the items outside that have a vector: those with as many words as the last in the list by words, and those with fewer
    same = F.when(F.col("lex").isNotNull(), _fused(F.col("lex"), F.greatest("vec", "tied"), none, F.col("any_chunk"))).otherwise(0.0)
    fewer = _fused(F.coalesce("less", "rank_zero", F.lit(1)), F.col("vec"), none, F.col("any_chunk"))
    open_ = cut(edge.where(F.col("vec").isNotNull() & (F.col("least").isNull() | (F.col("least") <= F.greatest(same, fewer)))).select("qid"))
    out = placed.where(F.col("place") <= shown).select(*RANKED)
    if open_.isEmpty():
        return out
    again = hybrid(questions.join(open_, "qid", "left_semi"), items, chunks, limit).where(F.col("place") <= shown)
    return out.join(open_, "qid", "left_anti").unionByName(again.select(*RANKED))


def beside(items: DataFrame, anchors: DataFrame) -> DataFrame:
    """Items (qid, id, ...) without those that a question (qid, id) already has: its anchor, or its working set."""
    return items.join(anchors.select("qid", "id"), ["qid", "id"], "left_anti")


def best_passage(ranks: DataFrame) -> DataFrame:
    """(qid, id) of the item of the nearest passage, for questions where just one has rank 1."""
    first = ranks.where("chunk_rank = 1")
    return first.withColumn("n", F.count("*").over(Window.partitionBy("qid"))).where("n = 1").select("qid", "id")


def pins(history: DataFrame, limit: int = vocab.PIN_SLOTS) -> DataFrame:
    """(conv_id, id, place): cited items of a conversation, the k-th citations of all turns together, newest turn first.

    history (conv_id, turn, citations array<bigint>): null ids are dropped before they are counted; of an item cited
    again the first place stays.
    """
    cited = history.select("conv_id", "turn", F.posexplode(F.filter("citations", lambda c: c.isNotNull())).alias("layer", "id"))
    first = cited.withColumn("seen", F.row_number().over(Window.partitionBy("conv_id", "id").orderBy("layer", F.desc("turn")))).where("seen = 1")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("layer", F.desc("turn"))))
    return placed.where(F.col("place") <= limit).select("conv_id", "id", "place")


def context(
    ranked: DataFrame, refs: DataFrame, pinned: DataFrame, best: DataFrame | None = None, web: DataFrame | None = None,
    k_deep: int = vocab.DEEP_SLOTS, index_limit: int = vocab.INDEX_TOP, best_known: bool = False,
) -> DataFrame:
    """(qid, id, n, depth, and uri where web is given): the numbered context of each question.

    ranked (qid, id, place), refs and pinned (qid, id, place), best (qid, id), web (qid, place, uri). Deep slots take
    references, then the item of the best passage if it is ranked (best_known: ranked holds the shown items only, and best items are known to exist), then ranked items. The index takes the ranked items
    that are not deep, as many as the limit leaves beside the deep ones. Pinned items that are in neither come last, and
    take the place of the index's tail. Sources of the web come after all others and count for no limit. Numbers run on.
    """
    first = Window.partitionBy("qid", "id").orderBy("section", "place")
    offered = refs.select("qid", "id", F.lit(0).alias("section"), "place")
    if best is not None:
        own = best.select("qid", "id") if best_known else best.select("qid", "id").join(ranked.select("qid", "id"), ["qid", "id"], "left_semi")
        offered = offered.unionByName(own.select("qid", "id", F.lit(1).alias("section"), F.lit(1).alias("place")))
    top = ranked.where(F.col("place") <= index_limit)  # no item further down can be shown for its rank
    offered = offered.unionByName(top.select("qid", "id", F.lit(2).alias("section"), "place"))
    once = offered.withColumn("seen", F.row_number().over(first)).where("seen = 1")
    deep = once.withColumn("o", F.row_number().over(Window.partitionBy("qid").orderBy("section", "place"))).where(F.col("o") <= min(k_deep, index_limit)).select("qid", "id", "o")
    room = deep.groupBy("qid").agg((F.lit(index_limit) - F.count("*")).alias("room"))
    shown = top.join(deep.select("qid", "id"), ["qid", "id"], "left_anti").withColumn("o", F.row_number().over(Window.partitionBy("qid").orderBy("place")))
    shown = shown.join(room, "qid").where(F.col("o") <= F.col("room")).select("qid", "id", "o", "room")
    there = deep.select("qid", "id").unionByName(shown.select("qid", "id"))
    pins_ = pinned.join(there, ["qid", "id"], "left_anti").withColumn("o", F.row_number().over(Window.partitionBy("qid").orderBy("place")))
    pins_ = pins_.join(room, "qid", "left").where(F.col("o") <= F.coalesce("room", F.lit(index_limit))).select("qid", "id", "o")
    taken = pins_.groupBy("qid").agg(F.count("*").alias("pins"))
    shown = shown.join(taken, "qid", "left").where(F.col("o") <= F.col("room") - F.coalesce("pins", F.lit(0)))
    part = lambda df, n, depth: df.select("qid", "id", F.lit(n).alias("part"), "o", F.lit(depth).alias("depth"))
    both = part(deep, 0, "deep").unionByName(part(shown, 1, "index")).unionByName(part(pins_, 2, "index"))
    number = F.row_number().over(Window.partitionBy("qid").orderBy("part", "o")).alias("n")
    if web is None:
        return both.select("qid", "id", number, "depth")
    tail = web.select("qid", F.lit(None).cast(both.schema["id"].dataType).alias("id"), F.lit(3).alias("part"), F.col("place").alias("o"), F.lit("web").alias("depth"), "uri")
    return both.withColumn("uri", F.lit(None).cast("string")).unionByName(tail).select("qid", "id", number, "depth", "uri")


def citations(answers: DataFrame, mapping: DataFrame) -> DataFrame:
    """(aid, n, id, kind, place): an answer's markers that the mapping (aid, n, id, kind) has, first occurrences in order."""
    found = answers.select("aid", F.posexplode(text.markers(F.col("answer"))).alias("pos", "n"))
    first = found.groupBy("aid", "n").agg(F.min("pos").alias("pos")).join(mapping, ["aid", "n"])
    return first.select("aid", "n", "id", "kind", F.row_number().over(Window.partitionBy("aid").orderBy("pos")).alias("place"))


def missing_roles(asked: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, role): roles asked for, asked (qid, roles), that no item (roles) has."""
    held = items.select(F.explode("roles").alias("role")).distinct()
    return asked.select("qid", F.explode(F.array_distinct("roles")).alias("role")).join(held, "role", "left_anti").select("qid", "role")


def hidden(relevant: DataFrame, shown: DataFrame) -> DataFrame:
    """(qid, matched, hidden): items with a term of the question, and those of them that the context shows nowhere."""
    seen = shown.select("qid", "id", F.lit(1).alias("seen"))
    return relevant.join(seen, ["qid", "id"], "left").groupBy("qid").agg(F.count("*").alias("matched"), F.count_if(F.col("seen").isNull()).alias("hidden"))
