"""Filtered, sorted, paged and counted views of items."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft import vocab
from weft.functions import text
from weft.functions.scoring import lookup


@dataclass
class Filters:
    """What a page is filtered by; empty lists and nulls don't filter. The search text keeps its wildcards."""

    roles: list[str] = field(default_factory=list)
    urgency: list[str] = field(default_factory=list)
    tiers: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    momentum: list[str] = field(default_factory=list)
    relevance: list[str] = field(default_factory=list)
    search: str | None = None
    since: str | None = None


def visible(items: DataFrame) -> DataFrame:
    return items.where((F.col("status") == "published") & F.col("is_primary"))


def filtered(items: DataFrame, by: Filters) -> DataFrame:
    out = visible(items)
    if by.roles:
        out = out.where(F.arrays_overlap("roles", F.array(*map(F.lit, by.roles))))
    for column, values in (("urgency", by.urgency), ("tier", by.tiers), ("source", by.sources), ("momentum", by.momentum), ("relevance", by.relevance)):
        if values:
            out = out.where(F.col(column).isin(values))
    if by.search:
        out = out.where(F.greatest(*[F.coalesce(F.ilike(F.col(c), F.lit(f"%{by.search}%")), F.lit(False)) for c in ("title", "body", "event_type", "impact_label", "nature")]))
    if by.since:
        out = out.where(F.col("published_at") >= F.expr(f"timestamp_ntz'{by.since}'"))
    return out


ORDERS = {
    "newest": lambda: [F.col("published_at").desc_nulls_last()],
    "oldest": lambda: [F.col("published_at").asc_nulls_last()],
    "impact": lambda: [lookup(F.col("impact_label"), vocab.IMPACT_ORDER, 6), F.col("published_at").desc_nulls_last()],
    "urgency": lambda: [lookup(F.col("urgency"), vocab.URGENCY_ORDER, 5), F.col("published_at").desc_nulls_last()],
    "score": lambda: [F.col("score").desc_nulls_last(), F.col("published_at").desc_nulls_last()],
    "trust": lambda: [F.col("trust_score").desc_nulls_last(), F.col("published_at").desc_nulls_last()],
}


def page(items: DataFrame, by: Filters, order: str = "newest", number: int = 1, size: int = 20) -> DataFrame:
    """One page in a total order; ids break ties."""
    return filtered(items, by).orderBy(*ORDERS[order](), "id").offset((number - 1) * size).limit(size)


def total(items: DataFrame, by: Filters) -> DataFrame:
    return filtered(items, by).agg(F.count("*").alias("total"))


def kpis(items: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: visible items, those of high impact, those of risk or compliance, and active sources."""
    return visible(items).agg(
        F.count("*").alias("total"), F.count_if(F.col("impact_label").isin(vocab.KPI_IMPACTS)).alias("high_impact"), F.count_if(F.col("nature").isin(vocab.KPI_NATURES)).alias("risks"),
    ).withColumn("sources", sources.where("active").agg(F.count("*")).scalar())


def source_counts(sources: DataFrame, items: DataFrame) -> DataFrame:
    """Every source with its number of visible items, zeros kept: the items are filtered before the outer join."""
    counts = visible(items).groupBy("source").agg(F.count("id").alias("n"))
    return sources.join(counts, sources.name == counts.source, "left").select("name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_items"))


def references(items: DataFrame) -> DataFrame:
    """(id, cluster_id, n_others): every item of a cluster, with the number of the other published items there.

    Membership and counts say all that the pairs would, and grow with the items, not with the square of a cluster. Items
    without a cluster are left out; ids are taken to be unique.
    """
    known = items.where("cluster_id is not null").select("id", "cluster_id", F.coalesce(F.col("status") == "published", F.lit(False)).cast("bigint").alias("own"))
    counts = known.groupBy("cluster_id").agg(F.sum("own").alias("n"))
    return known.join(counts, "cluster_id").select("id", "cluster_id", (F.col("n") - F.col("own")).alias("n_others"))


def references_of(items: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, other): the other published items in the clusters of the asked items (id), as the page of an item lists them.

    asked is meant to be a page of ids; repeated and unknown ids and items without a cluster add nothing.
    """
    known = items.where("cluster_id is not null")
    mine = known.join(asked.select("id").distinct(), "id", "left_semi").select("id", "cluster_id")
    others = known.where("status = 'published'").select("cluster_id", F.col("id").alias("other"))
    return mine.join(others, "cluster_id").where("id != other").select("id", "other")


def by_ids(items: DataFrame, wanted: DataFrame, cap: int) -> DataFrame:
    """(list_id, pos, id, title): items of lists (list_id, ids) in the caller's order, dead ids out, cap at most."""
    asked = wanted.select("list_id", F.posexplode("ids").alias("at", "id"))
    found = asked.join(items.select("id", "title"), "id")
    return found.withColumn("pos", F.row_number().over(Window.partitionBy("list_id").orderBy("at"))).where(F.col("pos") <= cap).select("list_id", "pos", "id", "title")


def page_links(pages: DataFrame, reach: int = 1) -> DataFrame:
    """(pages, current, pos, label): page numbers about the current one with the ends, gaps as an ellipsis."""
    numbers = pages.select("pages", "current", F.explode(F.sequence(F.lit(1), "pages")).alias("n"))
    kept = numbers.where((F.col("n") == 1) | (F.col("n") == F.col("pages")) | (F.abs(F.col("n") - F.col("current")) <= reach))
    of = Window.partitionBy("pages", "current").orderBy("n")
    marked = kept.withColumn("gap", F.col("n") - F.lag("n").over(of) > 1)
    shown = marked.select("pages", "current", "n", F.explode(F.when(F.col("gap"), F.array(F.lit("…"), F.col("n").cast("string"))).otherwise(F.array(F.col("n").cast("string")))).alias("label"))
    return shown.select("pages", "current", F.row_number().over(Window.partitionBy("pages", "current").orderBy("n", F.col("label") != "…")).alias("pos"), "label")


def serialised(items: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Items as they are served: with their source's name and trust tier, the text (normalised, else raw) and main image of their document.

    items (id, document_id, ...), documents (document_id, source_id, raw, normalised, metadata_image), sources (source_id, name, trust_tier).
    """
    joined = items.join(documents, "document_id").join(sources, "source_id")
    shown = F.when(F.coalesce("normalised", F.lit("")) != "", F.col("normalised")).otherwise(F.col("raw"))
    return joined.withColumn("content_text", shown).withColumn("image", text.primary_image(F.col("raw"), F.col("metadata_image"))).drop("raw", "normalised", "metadata_image")


def facets(counts: DataFrame, search: str = "", limit: int = 12) -> DataFrame:
    """Sources (name, n_items) whose name contains search: the first limit with items by count, then name, and those without."""
    found = counts.where(F.contains(F.lower("name"), F.lit(search.lower()))).withColumn("has_items", F.col("n_items") > 0)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("has_items").orderBy(F.desc("n_items"), "name"))).where(F.col("place") <= limit)


def tier_distribution(items: DataFrame) -> DataFrame:
    """(tier, n) of all items."""
    return items.groupBy("tier").agg(F.count("*").alias("n"))


def same_preset(a: Column, b: Column) -> Column:
    """Whether two choices of a filter are one: as many entries, and all of b among a."""
    return (F.size(a) == F.size(b)) & F.forall(b, lambda x: F.array_contains(a, x))
