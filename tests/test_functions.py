"""Column functions on literal tables."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft import vocab
from weft.functions import intent, model_json, scoring, text, vectors
from weft.operators import chunks

NOW = datetime(2026, 8, 1)


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def one(spark, value, f):
    return values(spark, [(value,)], "x string", f(F.col("x")).alias("y"))[0][0]


def test_html_text(spark):
    page = "<p>Hello <b>World</b>!</p><script>x</script><style>y</style><noscript>n</noscript><iframe>i</iframe><!-- c -->&nbsp;&lt;&amp;"
    assert one(spark, page, text.html_text) == "Hello World ! <&" and one(spark, None, text.html_text) == ""
    assert len(one(spark, "a" * 9000, text.html_text)) == 8000


def test_fingerprint(spark):
    rows = [(" HTTPS://a ", "T "), ("https://a", "t")]
    (a,), (b,) = values(spark, rows, "u string, t string", text.fingerprint(F.col("u"), F.col("t")))
    assert a == b and len(a) == 64


@pytest.mark.parametrize(("f", "value", "want"), [
    (text.star_count, " 1.2k ", 1200), (text.star_count, "3,456", 3456), (text.star_count, "none", None),
    (text.email, " A@B.c ", "a@b.c"), (text.email, "a b@c.d", None), (text.masked_email, "anna@x.y", "an***@x.y"),
    (text.listed, " a, ,b ", ["a", "b"]), (text.listed, None, []), (text.escaped, "<a&\">", "&lt;a&amp;&quot;&gt;"),
    (text.markers, "x [1] y [12][a] [1.5] [1]", [1, 12, 1]), (text.to_last_sentence, "One. Two! thr", "One. Two!"),
    (text.host, "https://A.b:8/x", "a.b"), (text.says_not_found, "Tôi KHÔNG tìm thấy gì", True),
    (text.question_terms, "Có tin AI nào cho Rust x không rust", ["rust", "rust"]), (text.card_title, "short\na line of more than twenty-five", "a line of more than twenty-five"),
    (text.card_title, None, ""), (text.sentences, "A b. C! d", ["A b.", "C!", "d"]), (text.is_vietnamese, "Phát HÀNH", True), (text.is_vietnamese, "plain", False),
])
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_more_text(spark):
    assert one(spark, "claim ｜ p | why", lambda x: text.verdict(x)["mark"]) == "P" and one(spark, "bad", lambda x: text.verdict(x)["mark"]) is None
    assert one(spark, "See [1] and [9].", lambda x: text.without_unmapped(x, F.array(F.lit(1)))) == "See [1] and."
    assert one(spark, "alpha beta gamma", lambda x: text.shortened(x, 12)) == "alpha beta…"
    links = {"https://o.x/a": "https://o.x/a", "//o.x/a": "https://o.x/a", "/a": "https://h.x/a", "a": "https://h.x/d/a"}
    for link, want in links.items():
        assert one(spark, link, lambda x: text.absolute(F.lit("https://h.x/d/p.html?q=1/2"), x)) == want
    assert one(spark, None, lambda x: text.grounded(F.lit("answer"), F.lit(0), "sorry")) == "sorry"
    image = '<img class=a src="https://x/pixel.gif"><meta name="twitter:image" content="t.png">'
    assert one(spark, image, text.primary_image) == "t.png" and one(spark, '<img src="logo.png">', text.primary_image) is None


@pytest.mark.parametrize(("question", "want"), [
    ("xin chào bạn", "salutation"), ("cảm ơn nhé", "thanks"), ("bạn làm được gì", "capability"), ("trợ lý hoạt động thế nào", "capability"), ("giới thiệu đi", "ambiguous"),
    ("bot này dùng để làm gì", "ambiguous"), ("nó là ai", None), ("công cụ này hỗ trợ gì", None), ("OpenSSL là gì", None), ("API mới của OpenAI dùng để làm gì", None), ("", None), (None, None), ("hi", "salutation"), ("high", None),
])
def test_intent(spark, question, want):
    assert one(spark, question, intent.route) == want
    assert one(spark, question, intent.classify) == (None if want == "ambiguous" else want)


def test_scores(spark):
    rows = [("Nghiêm trọng", NOW - timedelta(days=1)), ("Cao", NOW - timedelta(days=20)), ("Cao", NOW - timedelta(days=13)), ("Thấp", NOW), ("Nghiêm trọng", NOW - timedelta(days=14)), (None, NOW), ("Cao", None), ("Nghiêm trọng", None)]
    as_of = F.lit(NOW).cast("timestamp_ntz")
    got = values(spark, rows, "i string, p timestamp_ntz", scoring.urgency(F.col("i"), F.col("p"), as_of))
    assert [x for (x,) in got] == ["critical", "medium", "high", "low", "low", "low", "medium", "critical"]
    times = [(NOW + timedelta(hours=12),), (NOW - timedelta(hours=12),), (NOW - timedelta(days=30),), (NOW - timedelta(days=31),), (None,)]
    got = values(spark, times, "p timestamp_ntz", scoring.age_days(F.col("p"), as_of), F.round(scoring.recency(F.col("p"), as_of), 4))
    assert got == [(-1, 1.0), (0, 1.0), (30, 0.25), (31, 0.1), (None, 0.25)]
    got = values(spark, [(1, 2), (1, 3), (2, 1), (3, 6), (3, 7)], "n int, a int", scoring.momentum(F.col("n"), F.col("a")))
    assert [x for (x,) in got] == ["new", "mature", "mature", "rising", "mature"]


def test_validation(spark):
    schema = "roles array<string>, recs map<string, struct<action_type: string, note: string, urgency: string>>"
    recs = {"Dev": ("read", " n ", "now"), "Security": ("buy", "n", "low"), "Ghost": ("read", "n", "low")}
    (row, empty) = values(spark, [(["Dev", "Dev", "Chef", "Security"], recs), (None, {})], schema, scoring.valid_roles(F.col("roles")), scoring.valid_recommendations(F.col("recs"), F.col("roles")))
    assert row[0] == ["Dev", "Dev", "Security"] and {k: tuple(v) for k, v in row[1].items()} == {"Dev": ("read", "n", "medium")}
    assert empty == ([], None)
    topics = values(spark, [(["LLM", "AI/ML", "?", "Data Engineering"],), (None,)], "t array<string>", scoring.remapped_topics(F.col("t")))
    assert topics == [(["AI/ML Ứng dụng", "Data Engineering"],), ([vocab.DEFAULT_TOPIC],)]


def test_model_json(spark):
    raw = 'x {"pass": true, "score": 7, "content_type": "odd", "practical_indicators": {"has_api_change": true, "has_benchmark": "maybe", "zzz": true}} y'
    got = one(spark, raw, model_json.gate_result)
    assert (got["pass"], got["score"], got["content_type"], got["ok"]) == (True, 1.0, "noise", True)
    assert one(spark, raw, model_json.indicators) == {"has_api_change": True}
    assert not one(spark, "no json", model_json.gate_result)["ok"] and not one(spark, None, model_json.gate_result)["ok"]


def test_vectors(spark):
    got = values(spark, [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>", F.round(vectors.cosine(F.col("a"), F.col("b")), 6))
    assert [x for (x,) in got] == [0.96, 0.0, None]


def test_passages():
    assert chunks.passages(None) == [] and chunks.passages("short " * 10) == []
    assert chunks.passages("word " * 100) == [("word " * 100).strip()]
    long = " ".join(f"Sentence number {i} has some words." for i in range(230))[:8000]
    out = chunks.passages(long)
    assert 2 <= len(out) <= 6 and all(vocab.CHUNK_MIN <= len(p) <= vocab.CHUNK_MAX for p in out) and out == chunks.passages(long)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n!é", max_size=9000))
def test_passages_drop_no_word(body):
    out = chunks.passages(body)
    if len(body.strip()) >= vocab.CHUNK_MIN:
        assert all(p in body or "\n" in p for p in out)
        assert sum(map(len, out)) <= 2 * len(body) + 10
