"""Connectors as DataFrame transformations: fetched payloads in, entry rows out. Fetching itself stays outside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weft.functions import text

ENTRY_COLUMNS = ["source", "position", "url", "title", "raw_content", "author", "published_at"]
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def connector(kind: str):
    """Register a connector; each takes payloads (source, url, payload) and returns ENTRY_COLUMNS."""

    def add(f):
        REGISTRY[kind] = f
        return f

    return add


def fetched(payloads: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(entries, skipped): payloads (kind, source, url, payload) through their connectors; rows of unknown kinds are skipped."""
    out = None
    for kind, f in REGISTRY.items():
        part = f(payloads.where(F.col("kind") == kind), **options.get(kind, {})).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out, payloads.where(~F.coalesce(F.col("kind").isin(list(REGISTRY)), F.lit(False)))


def tag(xml: Column, *names: str) -> Column:
    """Text of the first of the elements that is there, CDATA and entities undone; null without any."""
    found = []
    for name in names:
        inner = F.regexp_extract(xml, f"(?s)<{name}(?:\\s[^>]*)?>(.*?)</{name}>", 1)
        inner = F.regexp_replace(inner, "(?s)^\\s*<!\\[CDATA\\[(.*?)\\]\\]>\\s*$", "$1")
        for entity, char in text.ENTITIES:
            inner = F.replace(inner, F.lit(entity), F.lit(char))
        found.append(F.nullif(F.trim(inner), F.lit("")))
    return F.coalesce(*found)


def timestamp(value: Column) -> Column:
    """ISO-8601 or RFC-822 time as naive UTC; null where it is neither."""
    iso = F.try_to_timestamp(value)
    rfc = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(value, "^[A-Za-z]{3}, *", ""), " (GMT|UT|UTC|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(F.coalesce(iso, rfc), F.current_timezone()), "yyyy-MM-dd HH:mm:ss"))


def _limited(rows: DataFrame, max_items: int) -> DataFrame:
    """The first max_items rows of each source's page, positions counted anew."""
    of = Window.partitionBy("source", "page").orderBy("at")
    return rows.withColumn("position", F.row_number().over(of)).where(F.col("position") <= max_items).select(ENTRY_COLUMNS)


def _feed(payloads: DataFrame) -> DataFrame:
    found = F.regexp_extract_all("payload", F.lit("(?s)<(item|entry)(?:\\s[^>]*)?>.*?</\\1>"), F.lit(0))
    return payloads.select("source", F.col("url").alias("page"), F.posexplode(found).alias("at", "x"))


@connector("rss")
def rss(payloads: DataFrame, max_items: int = 20, full_text: DataFrame | None = None, short: int = 1000) -> DataFrame:
    """RSS and Atom items: content before summary, titles cut at 500 and authors at 255 characters.

    full_text (url, full) replaces contents under short characters where it is longer.
    """
    x = F.col("x")
    link = F.coalesce(tag(x, "link"), F.nullif(F.regexp_extract(x, "<link\\s[^>]*href=[\"']([^\"']+)", 1), F.lit("")))
    rows = _feed(payloads).select(
        "source", "page", "at", link.alias("url"), F.substring(F.coalesce(tag(x, "title"), F.lit("Untitled")), 1, 500).alias("title"),
        F.coalesce(tag(x, "content:encoded", "content"), tag(x, "description", "summary"), F.lit("")).alias("raw_content"),
        F.substring(tag(x, "dc:creator", "author"), 1, 255).alias("author"), timestamp(tag(x, "pubDate", "published", "updated")).alias("published_at"),
    )
    if full_text is not None:
        rows = rows.join(full_text, "url", "left")
        longer = (F.length("raw_content") < short) & (F.length("full") > F.length("raw_content"))
        rows = rows.withColumn("raw_content", F.when(longer, F.col("full")).otherwise(F.col("raw_content")))
    return _limited(rows, max_items)


@connector("reddit")
def reddit(payloads: DataFrame, max_items: int = 25, articles: DataFrame | None = None) -> DataFrame:
    """Posts of a feed: own posts keep their text, link posts take that of articles (url, content); removed and empty ones are out."""
    x = F.col("x")
    summary = F.coalesce(tag(x, "content", "summary", "description"), F.lit(""))
    permalink = F.coalesce(F.nullif(F.regexp_extract(x, "<link\\s[^>]*href=[\"']([^\"']+)", 1), F.lit("")), tag(x, "link"))
    target = F.coalesce(F.nullif(F.regexp_extract(summary, "<a\\s+href=\"([^\"]+)\"[^>]*>\\[link\\]</a>", 1), F.lit("")), permalink)
    body = F.coalesce(F.nullif(F.regexp_extract(summary, "(?s)<div class=\"md\">(.*?)</div>", 1), F.lit("")), summary)
    rows = _feed(payloads).where(F.col("at") < max_items).select(
        "source", "page", "at", permalink.alias("permalink"), target.alias("target"), F.coalesce(tag(x, "title"), F.lit("Untitled")).alias("title"),
        text.html_text(body).alias("own"), tag(x, "name", "author").alias("author"),
    )
    is_self = (F.col("target") == F.col("permalink")) | F.col("target").rlike("reddit\\.com/r/.*/comments/")
    rows = rows.withColumn("is_self", is_self).withColumn("url", F.when(is_self, F.col("permalink")).otherwise(F.col("target")))
    linked = articles if articles is not None else payloads.sparkSession.createDataFrame([], "url string, content string")
    rows = rows.join(linked, "url", "left").withColumn("raw_content", F.when(F.col("is_self"), F.col("own")).otherwise(F.col("content")))
    kept = rows.where(~F.coalesce("raw_content", F.lit("")).isin("", "[removed]", "[deleted]"))
    return _limited(kept.withColumn("published_at", F.expr("cast(null as timestamp_ntz)")), max_items)


@connector("hackernews")
def hackernews(payloads: DataFrame, max_items: int = 15, min_score: int = 50, articles: DataFrame | None = None) -> DataFrame:
    """Stories of a score: own texts, or those of articles (url, content) for links; stories without either are out."""
    schema = "array<struct<id: bigint, type: string, score: int, title: string, url: string, text: string>>"
    rows = payloads.select("source", F.col("url").alias("page"), F.posexplode(F.from_json("payload", schema)).alias("at", "x")).where(f"x.type = 'story' and x.score >= {int(min_score)}")
    linked = F.coalesce(F.col("x.url"), F.lit("")) != ""
    rows = rows.select(
        "source", "page", "at", F.when(linked, F.col("x.url")).otherwise(F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("x.id").cast("string"))).alias("url"),
        F.coalesce(F.nullif(F.col("x.title"), F.lit("")), F.lit("Untitled")).alias("title"), F.col("x.text").alias("own"), linked.alias("linked"),
    )
    found = articles if articles is not None else payloads.sparkSession.createDataFrame([], "url string, content string")
    rows = rows.join(found, "url", "left").withColumn("raw_content", F.when(F.col("linked"), F.col("content")).otherwise(F.col("own")))
    kept = rows.where(F.coalesce("raw_content", F.lit("")) != "")
    return _limited(kept.select("*", F.lit(None).cast("string").alias("author"), F.expr("cast(null as timestamp_ntz)").alias("published_at")), max_items)


@connector("huggingface")
def huggingface(payloads: DataFrame, max_items: int = 10, min_likes: int = 5) -> DataFrame:
    """Models of a list with enough likes, their content put together from the metadata."""
    schema = "array<struct<id: string, likes: int, downloads: bigint, tags: array<string>, pipeline_tag: string, library_name: string, createdAt: string>>"
    m = F.col("x")
    rows = payloads.select("source", F.col("url").alias("page"), F.posexplode(F.from_json("payload", schema)).alias("at", "x"))
    rows = rows.where((F.coalesce(m["id"], F.lit("")) != "") & (F.coalesce(m["likes"], F.lit(0)) >= min_likes))
    tags = F.slice(F.filter(F.coalesce(m["tags"], F.array().cast("array<string>")), lambda t: F.length(t) < 40), 1, 10)
    parts = F.array(
        F.concat(F.lit("Model "), m["id"]), F.concat(F.lit("pipeline: "), F.coalesce(m["pipeline_tag"], F.lit("model"))), F.concat(F.lit("library: "), F.coalesce(m["library_name"], F.lit("?"))),
        F.concat(F.lit("likes: "), F.coalesce(m["likes"], F.lit(0)).cast("string")), F.concat(F.lit("downloads: "), F.coalesce(m["downloads"], F.lit(0)).cast("string")),
        F.when(F.size(tags) > 0, F.concat(F.lit("tags: "), F.array_join(tags, ", "))).otherwise(""),
    )
    return _limited(rows.select(
        "source", "page", "at", F.concat(F.lit("https://huggingface.co/"), m["id"]).alias("url"), m["id"].alias("title"), F.array_join(F.filter(parts, lambda p: p != ""), "\n\n").alias("raw_content"),
        F.col("source").alias("author"), timestamp(m["createdAt"]).alias("published_at"),
    ), max_items)


@connector("github_trending")
def github_trending(payloads: DataFrame, max_items: int = 25, readmes: DataFrame | None = None, readme_chars: int = 4000) -> DataFrame:
    """Repositories of a trending page: name, description, language, stars; readmes (url, readme) are appended, cut."""
    found = F.regexp_extract_all("payload", F.lit("(?s)<article[^>]*class=\"[^\"]*Box-row[^\"]*\"[^>]*>.*?</article>"), F.lit(0))
    x = F.col("x")
    name = F.trim(F.regexp_extract(x, "(?s)<h2[^>]*>.*?<a[^>]*href=\"/?([^\"]+)\"", 1))
    language = F.nullif(F.regexp_extract(x, "itemprop=\"programmingLanguage\"[^>]*>([^<]+)<", 1), F.lit(""))
    about = text.html_text(F.regexp_extract(x, "(?s)<p[^>]*>(.*?)</p>", 1))
    stars = text.star_count(F.nullif(text.html_text(F.regexp_extract(x, "(?s)href=\"[^\"]*/stargazers\"[^>]*>(.*?)</a>", 1)), F.lit("")))
    rows = payloads.select("source", F.col("url").alias("page"), F.posexplode(found).alias("at", "x")).where(name != "")
    rows = rows.select("source", "page", "at", F.concat(F.lit("https://github.com/"), name).alias("url"), name.alias("title"), language.alias("language"), about.alias("about"), stars.alias("stars"))
    known = readmes if readmes is not None else payloads.sparkSession.createDataFrame([], "url string, readme string")
    rows = rows.join(known, "url", "left")
    parts = F.array(
        F.col("about"), F.when(F.col("language").isNotNull(), F.concat(F.lit("language: "), F.col("language"))).otherwise(""),
        F.when(F.col("stars").isNotNull(), F.concat(F.lit("stars: "), F.col("stars").cast("string"))).otherwise(""), F.substring(F.coalesce("readme", F.lit("")), 1, readme_chars),
    )
    rows = rows.select("*", F.array_join(F.filter(parts, lambda p: p != ""), "\n").alias("raw_content"), F.split_part("title", F.lit("/"), F.lit(1)).alias("author"), F.expr("cast(null as timestamp_ntz)").alias("published_at"))
    return _limited(rows, max_items)


@connector("web_index")
def web_index(payloads: DataFrame, max_items: int = 10, include: str | None = None, exclude: tuple[str, ...] = (), articles: DataFrame | None = None, least: int = 100) -> DataFrame:
    """Articles behind a page's own links: absolute, same host, wanted, first seen, capped; with at least least characters in articles (url, content)."""
    rows = links(payloads, include, exclude)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("source", "page").orderBy("at"))).where(F.col("n") <= max_items)
    found = articles if articles is not None else payloads.sparkSession.createDataFrame([], "url string, content string")
    rows = rows.join(found, "url").where(F.length(F.trim("content")) >= least)
    return _limited(rows.select("source", "page", "at", "url", text.card_title(F.col("content")).alias("title"), F.col("content").alias("raw_content"), F.lit(None).cast("string").alias("author"), F.expr("cast(null as timestamp_ntz)").alias("published_at")), max_items)


def links(payloads: DataFrame, include: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(source, page, at, url): absolute addresses of a page's anchors on its own host, each where it is first seen."""
    found = F.regexp_extract_all("payload", F.lit("(?i)<a\\s[^>]*href=[\"']([^\"'#]+)"), F.lit(1))
    rows = payloads.select("source", F.col("url").alias("page"), F.posexplode(found).alias("at", "href")).where(F.trim("href") != "")
    rows = rows.withColumn("url", text.absolute(F.col("page"), F.trim("href"))).where(text.host(F.col("url")) == text.host(F.col("page")))
    if include:
        rows = rows.where(F.col("url").rlike(include))
    for pattern in exclude:
        rows = rows.where(~F.col("url").rlike(pattern))
    return rows.groupBy("source", "page", "url").agg(F.min("at").alias("at")).select("source", "page", "at", "url")


def feed_cards(cards: DataFrame, least: int = 100) -> DataFrame:
    """Cards (source, url, position, body) of a scrolled page as entries: stable text, first line as title, address by content; short and repeated ones out."""
    rows = cards.withColumn("raw_content", text.stable_lines(F.col("body"))).where(F.length(F.trim("raw_content")) >= least)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("source", F.sha2("raw_content", 256)).orderBy("position"))).where("n = 1")
    made = first.select("source", F.col("url").alias("page"), F.col("position").alias("at"), text.synthetic_url(F.col("url"), F.col("raw_content")).alias("url"), text.card_title(F.col("raw_content")).alias("title"), "raw_content", F.lit(None).cast("string").alias("author"), F.expr("cast(null as timestamp_ntz)").alias("published_at"))
    return _limited(made, 1_000_000)


def silent_feeds(payloads: DataFrame) -> DataFrame:
    """Feeds without any item."""
    return payloads.join(_feed(payloads).select("source").distinct(), "source", "left_anti").select("source", "url")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, required: list[str]) -> DataFrame:
    """JSON lines by a schema; a broken line, a missing field or an empty file fails."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lacking = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in required]).first()
    if not lacking.n:
        raise ValueError(f"{path} has no rows")
    if empty := [c for c in required if lacking[c]]:
        raise ValueError(f"{path} lacks {', '.join(empty)} in some rows")
    return rows


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of labels (doc_id, human_label, passed): labels in capitals, yes, true and 1 as true."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.upper(F.trim("human_label")).alias("human_label"), F.lower(F.trim("passed")).isin("yes", "true", "1").alias("passed"))
