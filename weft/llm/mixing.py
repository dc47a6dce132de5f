"""Mixing sources to target weights: raking of token weights, then sampling by calibrated probabilities. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import WORD_PATTERN, cut, whole_text

ROUNDS = 8
SEED = 17
#: Name of a missing source, language or topic.
NONE = "(none)"
DIMS = ("source", "lang", "topic")
#: Up to so many cells are broadcast.
BROADCAST_CELLS = 200_000
#: Exponents that flatten each margin's share of the tokens into its target.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.9}


def n_tokens(text: Column) -> Column:
    """Words of a text."""
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def uniform(key: Column, seed: int = SEED) -> Column:
    """A fixed number in [0, 1) of a key: the first 13 hex digits of the MD5 of seed:key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") / float(16**13)


def counted(docs: DataFrame, topics: DataFrame | None) -> DataFrame:
    """doc_id, source, lang, topic and n_tokens of every document; topics: (doc_id, topic), of which the least topic of an id counts."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit(NONE)).alias("source"),
        F.coalesce("lang", F.lit(NONE)).alias("lang"), n_tokens(whole_text()).alias("n_tokens"),
    )
    if topics is None:
        return base.withColumn("topic", F.lit(NONE))
    one = topics.where("doc_id is not null").groupBy("doc_id").agg(F.min("topic").alias("topic"))
    return base.join(one, "doc_id", "left").withColumn("topic", F.coalesce("topic", F.lit(NONE)))


def targets(cells: DataFrame, temper: dict[str, float] = TEMPER, wanted: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """cells with t_source, t_lang, t_topic: the target token share of each row's margin.

    A margin's target is its share of the tokens to the power of its dimension, made to sum to one. wanted gives shares for values of
    a dimension instead, {"lang": {"en": 0.5, "de": 0.2}}: the values it does not name divide what is left to one by that rule,
    and shares of values that hold no tokens are divided among all others in proportion.
    """
    out = cells
    for dim in DIMS:
        if given := (wanted or {}).get(dim):
            out = out.join(_wanted(cells, dim, given, temper[dim]), dim)
            continue
        power = F.pow(F.sum("tokens").over(Window.partitionBy(dim)), F.lit(temper[dim]))
        whole = cells.groupBy(dim).agg(F.pow(F.sum("tokens"), F.lit(temper[dim])).alias("p")).agg(F.sum("p"))
        out = out.withColumn(f"t_{dim}", power / whole.scalar())
    return out


def _wanted(cells: DataFrame, dim: str, given: dict[str, float], power: float) -> DataFrame:
    """(dim, t_dim) of every value of a dimension by given shares."""
    rest = 1.0 - sum(given.values())
    if min(given.values()) < 0 or rest < -1e-9:
        raise ValueError(f"shares of {dim} have to be at least 0 and at most 1 together")
    shares = F.create_map(*[F.lit(x) for pair in given.items() for x in (pair[0], float(pair[1]))])
    named = F.try_element_at(shares, F.col(dim))
    margins = cells.groupBy(dim).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("p")).withColumn("share", named)
    free = F.sum(F.when(F.col("share").isNull(), F.col("p"))).over(Window.partitionBy())
    raw = margins.withColumn("raw", F.coalesce("share", F.lit(max(rest, 0.0)) * F.col("p") / free))
    return raw.select(dim, (F.col("raw") / F.sum("raw").over(Window.partitionBy())).alias(f"t_{dim}"))


def rake(cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """cells (source, lang, topic, tokens, t_*) with weight: iterative proportional fitting of tokens to the targets.

    Every round scales the weights of each source, then each language, then each topic to its target share.
    """
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for dim in DIMS:
            held = F.sum("weight").over(Window.partitionBy(dim))
            out = out.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"t_{dim}"), held), F.lit(0.0)))  # a share of 0 leaves no weight
    return out


def mix(docs: DataFrame, topics: DataFrame | None = None, rounds: int = ROUNDS, seed: int = SEED, temper: dict[str, float] = TEMPER, wanted: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, tilt, probability, selected) for every document.

    Tokens are counted in each cell of source, language and topic and raked to the targets; tilt is a cell's
    raked share over its own share of the tokens. probability is tilt over the largest tilt, the largest common
    rate at which none passes one, so that the expected tokens selected have exactly the raked mix. A document
    is selected where a fixed hash of its id and the seed falls below that.

    wanted gives target shares from outside, as targets() takes them; a value whose share is 0 is never selected.

    Missing sources, languages and topics form a margin of their own; null text is empty. Documents without
    tokens in a cell without tokens have tilt null, probability 1 and are kept, as they weigh nothing. A null
    doc_id draws as the text "null"; repeated rows draw alike; an empty table gives an empty result.
    """
    known = cut(counted(docs, topics))
    cells = known.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    raked = cut(rake(targets(cut(cells), temper, wanted), rounds))
    shares = [F.col(c) / raked.agg(F.sum(c)).scalar() for c in ("weight", "tokens")]
    tilted = cut(raked.select(*DIMS, (shares[0] / shares[1]).alias("tilt")))
    rates = cut(tilted.withColumn("rate", F.col("tilt") / tilted.agg(F.max("tilt")).scalar()))
    few = rates.count() <= BROADCAST_CELLS  # beyond it cells are joined, and the adaptive skew join splits hot ones
    drawn = known.join(F.broadcast(rates) if few else rates, list(DIMS), "left").withColumn("rate", F.coalesce("rate", F.lit(1.0)))
    return drawn.select(
        "doc_id", *DIMS, "n_tokens", F.round("tilt", 6).alias("tilt"), F.round("rate", 6).alias("probability"),
        (uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed) < F.col("rate")).alias("selected"),
    )


def topics_of(embeddings: DataFrame) -> DataFrame:
    """(doc_id, topic) from an embeddings table: its label, as text."""
    return embeddings.select(F.col("vec_id").cast("long").alias("doc_id"), F.col("label").cast("string").alias("topic"))


def oracle(rounds: int = ROUNDS, seed: int = SEED, documents: str = "documents") -> str:
    """DuckDB SQL of mix() over documents and embeddings."""
    steps = [
        f"k as (select d.doc_id, coalesce(d.source, '{NONE}') as source, coalesce(d.lang, '{NONE}') as lang, coalesce(e.topic, '{NONE}') as topic, "
        "len(regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+')) as n_tokens "
        f"from {documents} d left join (select vec_id, min(cast(label as varchar)) as topic from embeddings group by 1) e on e.vec_id = d.doc_id)",
        "c0 as (select source, lang, topic, cast(sum(n_tokens) as double) as tokens from k group by all having sum(n_tokens) > 0)",
    ]
    for dim in DIMS:
        steps.append(f"m_{dim} as (select {dim}, pow(sum(tokens), {TEMPER[dim]}) as p from c0 group by 1)")
    steps.append(
        "w0 as (select c0.*, tokens as weight, " + ", ".join(f"m_{d}.p / (select sum(p) from m_{d}) as t_{d}" for d in DIMS) + " from c0 "
        + " ".join(f"join m_{d} using ({d})" for d in DIMS) + ")"
    )
    at = 0
    for _ in range(rounds):
        for dim in DIMS:
            steps.append(f"w{at + 1} as materialized (select * replace (weight * t_{dim} / sum(weight) over (partition by {dim}) as weight) from w{at})")
            at += 1
    steps.append(f"t as (select source, lang, topic, (weight / sum(weight) over ()) / (tokens / sum(tokens) over ()) as tilt from w{at})")
    steps.append("r as (select *, tilt / max(tilt) over () as rate from t)")
    return (
        "with " + ",\n".join(steps) + "\nselect k.doc_id, source, lang, topic, n_tokens, round(tilt, 6) as tilt, round(coalesce(rate, 1.0), 6) as probability, "
        f"cast('0x' || substr(md5('{seed}:' || coalesce(cast(k.doc_id as varchar), 'null')), 1, 13) as bigint) / pow(16.0, 13) < coalesce(rate, 1.0) as selected "
        "from k left join r using (source, lang, topic)"
    )
