"""Entry points over written tables, published versions, and a fetch that goes wrong in every way."""

import time

import pytest
from pyspark.sql import functions as F

from weft import jobs
from weft.operators import lifecycle
from weft.plans import corpus
from weft.sources import fetch, sinks


def test_jobs(spark, sf_small, tmp_path, capsys):
    i = corpus.items(spark, sf_small)
    tables = {
        "items": i.withColumn("text", F.concat_ws(" ", "title", "body")), "subscribers": corpus.subscribers(spark, sf_small), "deliveries": corpus.deliveries(spark, sf_small),
        "judged": i.select("id", F.col("body").alias("content"), (F.col("id") % 3 != 0).alias("passed"), (F.col("id") % 6 == 5).alias("gate_failed"), "gate_score", "confidence"),
        "sent": corpus.subscribers(spark, sf_small).select("subscriber", (F.col("subscriber") % 2 == 0).alias("ok")),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/in/{name}")
    where = ["--tables", f"{tmp_path}/in", "--out"]
    jobs.main(["analysis", *where, f"{tmp_path}/a"], spark)
    assert spark.read.parquet(f"{tmp_path}/a/counters").agg(F.sum("n")).first()[0] == i.count()
    jobs.main(["dedup", *where, f"{tmp_path}/d", "--as-of", str(corpus.AS_OF)], spark)
    assert spark.read.parquet(f"{tmp_path}/d/clusters").count() > 0 and "clusters_created" in capsys.readouterr().out
    dry = jobs.main(["brief", *where, f"{tmp_path}/b", "--as-of", str(corpus.AS_OF), "--dry-run", "--force"], spark)
    assert list(dry) == ["digests"]
    done = jobs.main(["brief", *where, f"{tmp_path}/c", "--as-of", str(corpus.AS_OF), "--results", "sent", "--force"], spark)
    counts = spark.read.parquet(f"{tmp_path}/c/counters").first()
    digests = spark.read.parquet(f"{tmp_path}/c/digests")
    assert counts.sent + counts.failed == digests.select("subscriber").distinct().count() and list(done) == ["digests", "log", "counters"]
    assert spark.read.parquet(f"{tmp_path}/c/log").where("subscriber % 2 = 1").count() == 0
    with pytest.raises(SystemExit):
        jobs.main(["brief", *where, f"{tmp_path}/x", "--as-of", "2026-08-01"], spark)


def test_versions_are_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path / "fixture")
    df = spark.createDataFrame([(1, [0.12345678, 1.0]), (2, None)], "id long, v array<double>")
    with pytest.raises(ValueError, match="no version|versions"):
        sinks.publish({"corpus": df}, path) and sinks.published(spark, path, "other")
    first = sinks.published(spark, path)["corpus"].collect()
    assert sorted((r.id, r.v) for r in first) == [(1, [0.123457, 1.0]), (2, None)]

    @F.udf("long")
    def breaks(x):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        sinks.publish({"corpus": df.limit(1), "anchors": df.select(breaks("id").alias("id"))}, path)
    assert sinks.published(spark, path)["corpus"].count() == 2  # still the first version
    second = sinks.publish({"corpus": df.limit(1)}, path)
    assert sinks.published(spark, path)["corpus"].count() == 1
    spark.createDataFrame([(9, None)], df.schema).write.mode("append").parquet(f"{path}/{second}/corpus")
    with pytest.raises(ValueError, match="not what was published"):
        sinks.published(spark, path)


def test_fetch(spark):
    def resolve(method, uri, seconds):
        if uri.startswith("gone") or (uri.startswith("get") and method == "HEAD"):
            raise ConnectionError
        return uri + "!"

    def load(url, seconds):
        if url.startswith("slow"):
            time.sleep(2.5)
        if url.startswith("bad"):
            raise ValueError
        yield from [b"<title>T &amp; t</title><p>" if not url.startswith("blank") else b"<p>", b"x" * (500 if url.startswith("long") else 0), b"" if url.startswith("blank") else "né".encode()]

    names = ["ok", "", "gone", "get", "bad", None, "slow", "blank", "long", "never"]
    requests = spark.createDataFrame([(1, k, n) for k, n in enumerate(names)] + [(2, 5, "late"), (2, 1, "early")], "request long, place int, uri string")
    pages = fetch.fetched(requests, resolve, load, limit=7, seconds=1.0, most_bytes=300).cache()
    assert [(r.place, r.error) for r in pages.where("request = 1").orderBy("place").collect()] == [(0, None), (2, "unresolved"), (3, None), (4, "ValueError"), (6, "TimeoutError"), (7, None), (8, None)]
    sources = [tuple(r) for r in fetch.web_sources(pages).orderBy("request", "place").select("request", "place", "uri", "title").collect()]
    assert sources == [(1, 1, "ok!", "T & t"), (1, 2, "get!", "T & t"), (1, 3, "long!", "T & t"), (2, 1, "early!", "T & t"), (2, 2, "late!", "T & t")]
    assert pages.where("uri = 'long'").first().payload.count("x") == 300 - len("<title>T &amp; t</title><p>")


def test_insert_and_reset(spark):
    t = spark.createDataFrame([(1, "a")], "id long, v string")
    rows = spark.createDataFrame([(1, "z"), (2, "c"), (2, "b"), (None, "n")], "id long, v string")
    assert sorted(map(tuple, lifecycle.insert_new(t, rows, "id", "v").collect())) == [(1, "a"), (2, "b")]
    d = spark.createDataFrame([(1, "failed"), (2, "done"), (3, None)], "id long, status string")
    assert sorted(map(tuple, lifecycle.reset_failed(d).collect()), key=str) == [(1, "pending"), (2, "done"), (3, None)]
