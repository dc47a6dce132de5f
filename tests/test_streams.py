"""Streams give what the batch forms give."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from weft.streaming import streams


def stream(spark, rows, schema, folder, files=3):
    df = spark.createDataFrame(rows, schema)
    df.repartition(files).write.mode("overwrite").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_first_of_each_fingerprint(spark, tmp_path):
    rows = [(f"u{i % 5}", "t", datetime(2026, 7, 1) if i % 5 else datetime(2025, 1, 1)) for i in range(40)]
    s = stream(spark, rows, "url string, title string, published_at timestamp_ntz", tmp_path / "in")
    out = streams.drained(streams.fresh_entries(s, F.expr("timestamp_ntz'2026-08-01'")), str(tmp_path / "w"))
    assert sorted(r.url for r in out.collect()) == ["u1", "u2", "u3", "u4"]


def test_budget_of_days(spark, sf_small, tmp_path):
    events = spark.read.parquet(f"{sf_small}/events.parquet")
    s = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_small)
    got = streams.daily_budget(s).writeStream.outputMode("complete").format("memory").queryName("budget").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    got.awaitTermination()
    want = {r.day: r.n for r in events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).collect()}
    assert {r.day: r.n for r in spark.table("budget").collect()} == want


def test_cool_down(spark, tmp_path):
    hours = [0, 10, 47, 48, 50, 96, 97]
    rows = [(k, datetime(2026, 1, 1) + timedelta(hours=h)) for k in (1, 2) for h in hours]
    s = stream(spark, rows, "key long, ts timestamp", tmp_path / "in", files=1)
    out = streams.drained(streams.cooled(s), str(tmp_path / "w")).orderBy("key", "ts").collect()
    assert [r.sent for r in out] == [True, False, False, True, False, True, False] * 2


def test_sentinel_gate(spark, tmp_path):
    pieces = {1: ["[[", "OUT", "]]"], 2: ["[[", "Hello", " you"], 3: ["Hi"], 4: ["`[[OUT", "]]`"]}
    rows = [(r, i, p) for r, ps in pieces.items() for i, p in enumerate(ps)]
    s = stream(spark, rows, "request long, seq long, piece string", tmp_path / "in", files=1)
    shown = {}
    for r in streams.drained(streams.gated_tokens(s, "[[OUT]]"), str(tmp_path / "w")).orderBy("request", "seq").collect():
        shown[r.request] = shown.get(r.request, "") + r.shown
    assert shown == {1: "", 2: "[[Hello you", 3: "Hi", 4: ""}


def test_ledger(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    streams.record(spark.createDataFrame([("f0",)], "fingerprint string"), -1, ledger)
    s = stream(spark, [(f"f{i % 4}",) for i in range(12)], "fingerprint string", tmp_path / "in")
    streams.into_ledger(s, ledger, str(tmp_path / "w")).awaitTermination()
    assert sorted(r.fingerprint for r in spark.read.parquet(ledger).collect()) == ["f0", "f1", "f2", "f3"]
    again = spark.createDataFrame([("f9",), ("f1",), ("f9",), (None,)], "fingerprint string")
    for _ in range(2):  # a batch that is run again adds nothing
        streams.record(again, 77, ledger)
        assert sorted((r.fingerprint, r.batch) for r in spark.read.parquet(ledger).where("batch in (-1, 77)").collect()) == [("f0", -1), ("f9", 77)]
    assert spark.read.parquet(ledger).count() == 5


def test_frames_cut_anywhere(spark, tmp_path):
    frames = [("token", '{"text": "a\\n\\nb"}'), ("status", "{}"), ("commit", '{"n": 1}'), ("token", "é😀")]
    text = "".join(f"event: {k}\ndata: {d}\n\n" for k, d in frames) + ": note\n\ndata: x\ndata: y\n\nevent: lost"
    rows = [(1, i, c) for i, c in enumerate(text)] + [(2, i, text[i * 7 : i * 7 + 7]) for i in range(len(text) // 7 + 1)] + [(3, 0, "data: half")]
    s = stream(spark, rows, "request long, seq long, piece string", tmp_path / "in", files=1)
    got = sorted(map(tuple, streams.drained(streams.frames(s), str(tmp_path / "w")).collect()))
    assert got == [(r, n, k, d) for r in (1, 2) for n, (k, d) in enumerate([*frames, ("message", "xy")])]


def test_attempts_over_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, k, ok) for k, ok in enumerate([False, False, True, False, False, False, False])] + [(2, 0, True)], "source long, seq long, ok boolean")
    df.orderBy("seq").coalesce(1).write.option("maxRecordsPerFile", 2).parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = sorted((r.source, r.seq, r.attempt, r.state) for r in streams.drained(streams.attempts(s), str(tmp_path / "w")).collect())
    assert got == [(1, 0, 1, "retry"), (1, 1, 2, "retry"), (1, 2, 3, "done"), (1, 3, 1, "retry"), (1, 4, 2, "retry"), (1, 5, 3, "failed"), (1, 6, 1, "retry"), (2, 0, 1, "done")]
    assert streams.backoff(1, "a") < 3 <= streams.backoff(2, "a") + 1e-9 < 5.1
