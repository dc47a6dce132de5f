"""Rendering, answers and backfills on small tables."""

from datetime import datetime

from pyspark.sql import functions as F

from weft.functions import rendering as R
from weft.operators import answers as A
from weft.operators import catalog
from weft.sources import sinks


def lit(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_rendering(spark):
    n, none = F.lit(3), F.lit(None).cast("string")
    assert lit(spark, R.embedding_text(F.lit(" T "), none, F.lit(""), F.lit("S"), F.array(F.lit("a"), F.lit("b"))))[0] == "T\nS\na · b"
    when = F.lit(datetime(2026, 7, 1)).cast("timestamp_ntz")
    assert lit(spark, R.date_label(F.lit(None).cast("timestamp_ntz"), when), R.date_label(F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"))) == ("01/07/2026", "không rõ ngày")
    assert lit(spark, R.index_line(n, F.lit("T"), F.lit("sig"), F.lit("d")))[0] == "[3] T (d)\n    sig"
    assert lit(spark, R.deep_block(n, F.lit("T"), F.lit("d"), [("Why", F.lit("w")), ("So", none)], none))[0] == "[3] T (d)\nWhy: w\n(nội dung gốc đã hết hạn)"
    cites = F.array(F.struct(F.lit(1).alias("n"), F.lit("One").alias("title")))
    assert lit(spark, R.with_titles(F.lit("See [1] and [2]."), cites))[0] == "See «One» and."
    assert lit(spark, R.prompt(F.lit("q"), F.lit("c"), web=F.lit(""), instructions="do"))[0] == "do\n\n## Context\nc\n\n## Question\nq"
    assert lit(spark, R.bullets([F.lit("A"), none], F.lit("A sentence here. Tiny. Another sentence."), 3))[0] == ["A", "A sentence here.", "Another sentence."]
    assert lit(spark, R.digest_text(F.lit("S"), F.array(F.lit("x"), F.lit("y")), F.lit(4)), R.digest_html(F.lit("S"), F.array(F.lit("<x>")))) == ("S\n\n1. x\n2. y\n\n+4 more", "<h1>S</h1><ol><li>&lt;x&gt;</li></ol>")
    assert lit(spark, R.status_line(F.lit("reading"), F.lit(9), F.lit(2)), R.status_line(F.lit("other"), n, n), R.window(F.lit("abc"), 2)) == ("reading: 2 of 9 items", None, "ab")


def test_reading_back(spark):
    assert lit(spark, R.mentioned_roles(F.lit("tin cho Data Engineer và dev?")))[0] == ["Data Engineer", "Dev"]
    assert lit(spark, R.mentioned_roles(F.lit("devops data")))[0] == []
    assert lit(spark, R.is_sentinel(F.lit(" `[[OUT]]` "), "[[OUT]]"), R.is_sentinel(F.lit("[[OUT]] but"), "[[OUT]]")) == (True, False)
    assert lit(spark, R.web_query(F.lit("a [[WEB: who\nis]] b")), R.web_query(F.lit("a")), R.without_web_query(F.lit("a [[WEB: x]]"))) == ("who\nis", None, "a")


def test_answers(spark):
    rows = [(1, "Yes [1] and [7]."), (2, "`[[OUT]]`"), (3, "Tôi không tìm thấy tin."), (4, "Made up.")]
    mapping = spark.createDataFrame([(1, 1, 10), (4, 1, 10)], "aid long, n int, id long")
    out = {r.aid: r for r in A.resolved(spark.createDataFrame(rows, "aid long, answer string"), mapping, "[[OUT]]").collect()}
    assert [out[i].outcome for i in (1, 2, 3, 4)] == ["grounded", "out_of_scope", "not_found", "insufficient"]
    assert out[1].answer == "Yes [1] and." and out[1].n_citations == 1 and out[4].answer == A.INSUFFICIENT
    web = spark.createDataFrame([(1, "from the web")], "aid long, answer string")
    asked = spark.createDataFrame([(1, "[[WEB: q]]"), (2, "kept [[WEB: q]]"), (3, "plain")], "aid long, answer string")
    assert sorted(tuple(r) for r in A.with_web(asked, web).collect()) == [(1, "from the web", "web"), (2, "kept", "corpus"), (3, "plain", "corpus")]
    requests = spark.createDataFrame([([1], None), ([], 4), (None, None)], "refs array<long>, item_id long")
    assert [r.mode for r in A.mode(requests).collect()] == ["focused", "insight", "global"]


def test_backfills(spark):
    items = spark.createDataFrame([(i, f"word {i} " * 60) for i in range(5)], "id long, text string")

    def embed(texts):
        if any("word 4 " in t for t in texts):
            raise RuntimeError("model down")
        return [[float(len(t))] for t in texts]

    out = {r.id: r.emb for r in A.embedded(items.coalesce(1), embed, size=2).collect()}
    assert out[4] is None and out[0] == [float(len("word 0 " * 60))]
    have = A.passages_backfilled(items.where("id < 2"), spark.createDataFrame([], "id long, ordinal int, content string"))
    assert have.count() == 2 and A.passages_backfilled(items, have).count() == 5 and A.passages_backfilled(items, have, redo=True).count() == 5
    assert [r.id for r in A.lacking(items, have, limit=2).collect()] == [4, 3]


def test_checks(spark):
    events = [(1, 1, "status", "s"), (1, 2, "token", "t"), (1, 3, "commit", "c"), (2, 1, "token", "t"), (2, 2, "commit", "c"), (2, 3, "token", "t"), (3, 1, "commit", "3f2504e0-4f89-11d3-9a0c-0305e82c3301")]
    out = {r.request: (r.hard, r.soft) for r in A.acceptance(spark.createDataFrame(events, "request long, seq long, kind string, payload string")).collect()}
    assert out == {1: (True, True), 2: (False, False), 3: (False, True)}
    rate = A.sentinel_rate(spark.createDataFrame([(True, "[[OUT]]"), (True, "x"), (False, "[[OUT]]")], "answerable boolean, answer string"), "[[OUT]]").first()
    assert rate.false_positive_rate == 0.5
    scenarios = spark.createDataFrame([("a", "global", [1], None, []), ("a", "global", [1], None, []), ("b", "odd", [9], 3, [9]), ("c", "insight", [1], None, [])], "id string, mode string, must_have array<long>, anchor long, cited array<long>")
    found = {(r.id, r.problem) for r in A.integrity(scenarios, spark.range(5)).collect()}
    assert found == {("a", "repeated id"), ("b", "unknown mode"), ("b", "label outside the corpus"), ("b", "anchor and mode disagree"), ("b", "label already cited"), ("c", "anchor and mode disagree")}


def test_sinks(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [0.12345678, 1.0])], "id long, embedding array<double>")
    sinks.write_vectors(vectors, str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v")).first().embedding == [0.123457, 1.0]
    ranks = spark.createDataFrame([(1, 5, 2), (1, 6, 1)], "qid long, id long, chunk_rank long")
    sinks.write_ranks(ranks, str(tmp_path / "r"), [2000, 2400, 300], "m")
    assert spark.read.json(str(tmp_path / "r/meta")).first().n_ranks == 2 and spark.read.json(str(tmp_path / "r/ranks")).first().ranks.asDict() == {"5": 2, "6": 1}

    def send(who, lines):
        if who == "c":
            raise OSError("down")
        return len(lines) > 0

    digests = spark.createDataFrame([("a", ["x"]), ("b", []), ("c", ["y"])], "subscriber string, lines array<string>")
    assert sorted(tuple(r) for r in sinks.deliver(digests, send).collect()) == [("a", True), ("b", False), ("c", False)]
    messages = spark.createDataFrame([([("user", str(i), True) for i in range(60)],)], "m array<struct<role: string, content: string, pending: boolean>>")
    tail = messages.select(sinks.session_tail(F.col("m")).alias("t")).first().t
    assert len(tail) == 50 and tail[0].content == "10" and "pending" not in tail[0].asDict()


def test_serialised(spark):
    items = spark.createDataFrame([(1, 7)], "id long, document_id long")
    docs = spark.createDataFrame([(7, 3, "<img src='a.png'>", "", None)], "document_id long, source_id long, raw string, normalised string, metadata_image string")
    out = catalog.serialised(items, docs, spark.createDataFrame([(3, "n", "high")], "source_id long, name string, trust_tier string")).first()
    assert (out.content_text, out.image, out.name) == ("<img src='a.png'>", "a.png", "n")
