"""Interaction of filters: survivors of every subset by CUBE, and what each filter removes in every order."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import WORD_PATTERN, cut, whole_text

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, "#$%&*|"
BLANKS, CAPITALS = "\t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n", "good", "toxic")


def text_flags(text: str = "text") -> dict[str, Column]:
    """Failures that a text shows by itself: too short, repetitive, shouting, symbols. Null is the empty text."""
    whole = whole_text(text)
    words = F.array_remove(F.split(F.translate(whole, BLANKS, " " * len(BLANKS)), " "), "")
    capitals = F.length(whole) - F.length(F.translate(whole, CAPITALS, ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * capitals > CAPITAL_PERCENT * F.length(whole),
        "D": whole.rlike(f"[{SYMBOLS}]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, n, good, toxic): documents of each pattern of failures within a language.

    Rows shrink to id, digest and flags before they move. A document fails E where its text is that of a smaller id of the
    whole table; rows of the smallest id of a text, and rows of null ids, do not. Copies are counted for each text, language
    and label before their digest meets others of it, so a group of copies of any size moves as a few rows. Several labels
    of an id count as one that is good, or toxic, where any of them is. Labels of null ids belong to no document.
    """
    own = [k for k in FILTERS if k != "E"]
    flags = text_flags()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(whole_text(), 256)).alias("text"), *[flags[k].alias(k) for k in own],
    )
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    marks = [F.coalesce(k, F.lit(False)).alias(k) for k in ("good", "toxic")]
    each = rows.join(known, "id", "left").select("id", "part", "text", *own, *marks)
    kind = ["text", "part", *own, "good", "toxic"]
    ids = each.groupBy("id", *kind).agg(F.count("*").alias("n"))
    groups = cut(ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("of_least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without")))
    first = groups.groupBy("text").agg(F.min("least").alias("first"))
    kept = F.col("without") + F.when(F.col("least") == F.col("first"), F.col("of_least")).otherwise(0)
    split = groups.join(first, "text").select("part", *own, "good", "toxic", F.explode(F.array(
        F.struct(F.lit(False).alias("E"), kept.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - kept).alias("n")))).alias("x"))
    counted = lambda mark: F.coalesce(F.sum(F.when(F.col(mark), F.col("n"))), F.lit(0)).alias(mark)
    return split.select("part", *own, "x.*", "good", "toxic").where("n > 0").groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), counted("good"), counted("toxic"))


def survivors(patterns: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, mask, n, good, toxic): what every subset of the filters leaves of each part, zeros included.

    patterns is (part, a boolean for each filter, n, good, toxic). Bit i of mask selects the i-th filter. In a CUBE over part and
    flags, a row whose selected flags are all false counts those that no selected filter removes.
    """
    cube = patterns.cube("part", *filters).agg(F.grouping("part").alias("total"), *[F.grouping(k).alias(f"no_{k}") for k in filters], *[F.sum(c).alias(c) for c in COUNTS])
    none_fails = F.lit(True)
    mask = F.lit(0)
    for i, k in enumerate(filters):
        none_fails &= (F.col(f"no_{k}") == 1) | ~F.col(k)
        mask += (1 - F.col(f"no_{k}")) * (1 << i)
    found = cut(cube.where((F.col("total") == 0) & none_fails).select("part", mask.cast("int").alias("mask"), *COUNTS))
    every = found.where("mask = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("mask"))
    return every.join(found, ["part", "mask"], "left").select("part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def orders(filters: Sequence[str]) -> list[tuple[str, int, str, int, int, int, int]]:
    """(order, step, filter, and the masks before it, after it, of it alone, of all others) for every step of every permutation."""
    full, out = (1 << len(filters)) - 1, []
    for order in itertools.permutations(filters):
        before = 0
        for step, k in enumerate(order, 1):
            bit = 1 << filters.index(k)
            out.append(("".join(order), step, k, before, before | bit, bit, full & ~bit))
            before |= bit
    return out


def interactions(patterns: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of flag patterns.

    One row for each part, permutation of the filters and step, from the survivors of the subsets before and after the step.
    An empty table gives an empty result.
    """
    spark = patterns.sparkSession
    left = cut(survivors(patterns, filters))
    steps = spark.createDataFrame(orders(filters), "filter_order string, step int, filter string, before int, after int, alone int, others int")
    subset = lambda name, *counts: left.select("part", F.col("mask").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in counts])
    full = subset("full", "n").where(F.col("full") == (1 << len(filters)) - 1).drop("full")
    whole = subset("whole", "n").where("whole = 0").drop("whole")
    joined = (
        subset("before", *COUNTS).join(F.broadcast(steps), "before").join(subset("after", *COUNTS), ["part", "after"])
        .join(subset("alone", "n"), ["part", "alone"]).join(subset("others", "n"), ["part", "others"]).join(full, "part").join(whole, "part")
    )
    removed = F.col("before_n") - F.col("after_n")
    out = cut(joined.select(
        "part", "filter_order", "step", "filter", F.col("after_n").alias("kept"), removed.alias("removed"),
        (F.col("whole_n") - F.col("alone_n") - removed).alias("redundant"), (F.col("others_n") - F.col("full_n")).alias("unique_fails"),
        (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"),
    ))
    shares = out.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return out.join(shares, ["part", "filter"]).drop("filter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of five filters over whole texts of docs (doc_id, text, lang), with labels (doc_id, quality, toxic).

    The filters: A under 200 words, B fewer than half of the words distinct, C more than 3 % capitals, D any of #$%&*|, E the
    text of a smaller id. A null text is empty, a null language the part "". Equal texts of one id are no copies of each
    other; each row counts. More columns play no part. An empty table gives an empty result.
    """
    return interactions(cut(flagged(docs, labels)))


def oracle() -> str:
    """DuckDB SQL of audit() over documents and labels: every document is taken through every order."""
    flags: Mapping[str, str] = {
        "A": f"len(words) < {LEAST_WORDS}",
        "B": f"100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words)",
        "C": f"100 * len(regexp_extract_all(t, '[A-Z]')) > {CAPITAL_PERCENT} * length(t)",
        "D": f"regexp_matches(t, '[{SYMBOLS}]')",
        "E": "coalesce(doc_id > min(doc_id) over (partition by t), false)",
    }
    return f"""with l as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels where doc_id is not null group by 1),
w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}') as words from documents),
f as materialized (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, {", ".join(f"{v} as {k}" for k, v in flags.items())} from w left join l using (doc_id)),
c as (select part, good, toxic, [{", ".join(FILTERS)}] as fails, count(*) as n from f group by all),
one as (select unnest([{", ".join(f"'{k}'" for k in FILTERS)}]) as k, unnest(range(1, {len(FILTERS) + 1})) as place),
o as (select {" || ".join(f"x{i}.k" for i in range(len(FILTERS)))} as filter_order, [{", ".join(f"x{i}.place" for i in range(len(FILTERS)))}] as places from {", ".join(f"one x{i}" for i in range(len(FILTERS)))}
 where len(list_distinct([{", ".join(f"x{i}.k" for i in range(len(FILTERS)))}])) = {len(FILTERS)}),
s as (select part, filter_order, places, good, toxic, fails, n, list_position(list_transform(places, lambda p: fails[p]), true) as gone, len(list_filter(fails, lambda x: x)) as failing from c, o),
r as (select part, filter_order, step, places[step] as place,
  coalesce(sum(n) filter (gone is null or gone > step), 0)::bigint as kept, coalesce(sum(n) filter (gone = step), 0)::bigint as removed,
  coalesce(sum(n) filter (gone < step and fails[places[step]]), 0)::bigint as redundant, coalesce(sum(n) filter (failing = 1 and fails[places[step]]), 0)::bigint as unique_fails,
  coalesce(sum(n) filter (gone = step and good), 0)::bigint as good_lost, coalesce(sum(n) filter (gone = step and toxic), 0)::bigint as toxic_lost
 from s, (select unnest(range(1, {len(FILTERS) + 1})) as step) group by part, filter_order, step, places[step])
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, place))::bigint as shapley from r"""
