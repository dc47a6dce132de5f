"""Connectors on small payloads."""

import json

import pytest
from pyspark.sql import functions as F

from weft.sources import datasource
from weft.sources import entries as E

FEED = """<rss><channel>
<item><title>One &amp; only</title><link>https://a.example/1</link><description>short</description><content:encoded><![CDATA[<p>Body</p>]]></content:encoded><dc:creator>Ann</dc:creator><pubDate>Tue, 02 Jun 2026 10:00:00 GMT</pubDate></item>
<item><link>https://a.example/2</link><description>sum</description><pubDate>nonsense</pubDate></item>
<item><title>Three</title><link>https://a.example/3</link></item></channel></rss>"""


def payload(spark, text, url="https://a.example/feed"):
    return spark.createDataFrame([("src", url, text)], "source string, url string, payload string")


def rows(df):
    return [r.asDict() for r in df.orderBy("position").collect()]


def test_rss(spark):
    full = spark.createDataFrame([("https://a.example/2", "a longer text"), ("https://a.example/1", "x")], "url string, full string")
    out = rows(E.rss(payload(spark, FEED), max_items=2, full_text=full))
    assert [(r["url"], r["title"], r["raw_content"], r["author"]) for r in out] == [("https://a.example/1", "One & only", "<p>Body</p>", "Ann"), ("https://a.example/2", "Untitled", "a longer text", None)]
    assert str(out[0]["published_at"]) == "2026-06-02 10:00:00" and out[1]["published_at"] is None


def test_reddit(spark):
    def item(n, body, target):
        return f'<entry><title>T{n}</title><link href="https://www.reddit.com/r/x/comments/{n}/"/><content>{body} &lt;a href="{target}"&gt;[link]&lt;/a&gt;</content></entry>'

    feed = item(1, '&lt;div class="md"&gt;&lt;p&gt;Own  text&lt;/p&gt;&lt;/div&gt;', "https://www.reddit.com/r/x/comments/1/") + item(2, "", "https://b.example/z") + item(3, '&lt;div class="md"&gt;[removed]&lt;/div&gt;', "https://www.reddit.com/r/x/comments/3/")
    out = rows(E.reddit(payload(spark, feed), articles=spark.createDataFrame([("https://b.example/z", "article")], "url string, content string")))
    assert [(r["url"], r["raw_content"]) for r in out] == [("https://www.reddit.com/r/x/comments/1/", "Own text"), ("https://b.example/z", "article")]


def test_lists_of_json(spark):
    stories = [{"id": 1, "type": "story", "score": 60, "title": "Ask", "text": "body"}, {"id": 2, "type": "job", "score": 99}, {"id": 3, "type": "story", "score": 5, "text": "x"}, {"id": 4, "type": "story", "score": 70, "title": "L", "url": "https://c.example"}, {"id": 5, "type": "story", "score": 70}]
    out = rows(E.hackernews(payload(spark, json.dumps(stories)), articles=spark.createDataFrame([("https://c.example", "full")], "url string, content string")))
    assert [(r["title"], r["raw_content"]) for r in out] == [("Ask", "body"), ("L", "full")]
    models = [{"id": "o/m", "likes": 9, "tags": ["a", "b" * 50], "createdAt": "2026-05-01T08:00:00Z"}, {"id": "", "likes": 9}, {"id": "o/n", "likes": 1}]
    out = rows(E.huggingface(payload(spark, json.dumps(models))))
    assert len(out) == 1 and out[0]["url"] == "https://huggingface.co/o/m" and "tags: a" in out[0]["raw_content"] and str(out[0]["published_at"]) == "2026-05-01 08:00:00"


def test_trending(spark):
    page = '<article class="Box-row"><h2 class="h3"><a href="/o/r">o / r</a></h2><p>About it</p><span itemprop="programmingLanguage">Rust</span><a href="/o/r/stargazers"> 1.2k </a></article><article class="Box-row"><p>no name</p></article>'
    readmes = spark.createDataFrame([("https://github.com/o/r", "R" * 5000)], "url string, readme string")
    (r,) = rows(E.github_trending(payload(spark, page), readmes=readmes))
    assert (r["title"], r["author"]) == ("o/r", "o") and r["raw_content"] == "About it\nlanguage: Rust\nstars: 1200\n" + "R" * 4000


def test_web_index(spark):
    page = '<a href="/news/a">A</a><a href="b?x=1">B</a><a href="https://other.example/news/c">C</a><a href="/news/a">again</a><a href="/news/tag/x">t</a><a class=k href=\'//a.example/news/d\'>D</a>'
    articles = spark.createDataFrame([("https://a.example/news/a", "Title line that is long enough to be one\n" + "x" * 100), ("https://a.example/news/d", "short")], "url string, content string")
    base = payload(spark, page, "https://a.example/news/index.html")
    assert [r.url for r in E.links(base).orderBy("at").collect()] == ["https://a.example/news/a", "https://a.example/news/b?x=1", "https://a.example/news/tag/x", "https://a.example/news/d"]
    out = rows(E.web_index(base, include="/news/", exclude=("/tag/",), articles=articles))
    assert [(r["url"], r["title"]) for r in out] == [("https://a.example/news/a", "Title line that is long enough to be one")]


def test_cards(spark):
    body = "Ann\n12 comments\nA headline longer than twenty-five letters\n" + "text " * 30 + "\n3d • Edited\nLike"
    cards = spark.createDataFrame([("s", "https://i.example", 1, body), ("s", "https://i.example", 2, body.replace("12", "99")), ("s", "https://i.example", 3, "tiny")], "source string, url string, position int, body string")
    (r,) = rows(E.feed_cards(cards))
    assert r["title"] == "A headline longer than twenty-five letters" and "comments" not in r["raw_content"] and r["url"].startswith("https://i.example#post-") and len(r["url"]) == len("https://i.example#post-") + 16


def test_registry_and_silent_feeds(spark):
    mixed = spark.createDataFrame([("rss", "s", "https://a.example/feed", FEED), ("pigeon", "p", "u", "x"), (None, "n", "u", "x")], "kind string, source string, url string, payload string")
    entries, skipped = E.fetched(mixed)
    assert entries.count() == 3 and {r.source for r in skipped.collect()} == {"p", "n"}
    assert [r.source for r in E.silent_feeds(mixed).orderBy("source").collect()] == ["n", "p"]


def test_files(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"id": 1, "t": "x"}\n{"id": 2, "t": "y"}\n')
    assert E.read_jsonl(spark, str(good), "id long, t string", ["id"]).count() == 2
    good.write_text('{"id": 1}\n')
    with pytest.raises(ValueError, match="lacks t"):
        E.read_jsonl(spark, str(good), "id long, t string", ["t"])
    good.write_text("{broken\n")
    with pytest.raises(Exception):
        E.read_jsonl(spark, str(good), "id long, t string", ["id"])
    csv = tmp_path / "l.csv"
    csv.write_text("doc_id,human_label,passed\n1, signal ,Yes\n2,NOISE,0\n")
    assert [tuple(r) for r in E.read_labels(spark, str(csv)).orderBy("doc_id").collect()] == [(1, "SIGNAL", True), (2, "NOISE", False)]


def test_data_source(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"source": "s", "kind": "rss", "url": "u", "payload": FEED}))
    (tmp_path / "b.json").write_text("{")
    datasource.register(spark)
    got = spark.read.format("weft_payloads").option("path", str(tmp_path)).load()
    assert got.where("error is null").count() == 1 and got.where(F.col("error").isNotNull()).first().source == "b.json"
    assert E.rss(got.where("kind = 'rss'")).count() == 3
