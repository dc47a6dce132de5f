"""Structured Streaming forms of intake, budgets, cool-down and token gates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft import vocab
from weft.functions import text


def fresh_entries(entries: DataFrame, as_of, max_age_days: int = vocab.MAX_AGE_DAYS) -> DataFrame:
    """A stream of entries (url, title, published_at, ...) with fingerprints, each the first time it is seen; too old ones are out."""
    marked = entries.withColumn("fingerprint", text.fingerprint(F.col("url"), F.coalesce("title", F.lit(""))))
    recent = marked.where(F.coalesce("published_at", as_of) >= as_of - F.make_dt_interval(F.lit(max_age_days)))
    return recent.dropDuplicates(["fingerprint"])


def daily_budget(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events and their value by UTC day; days are final once late has passed."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.to_date("w.start").alias("day"), "n", "total")


def cooled(events: DataFrame, hours: int = vocab.COOLDOWN_HOURS) -> DataFrame:
    """A stream of (key, ts) with sent: whether hours have passed since the key's last sent event."""
    gap = pd.Timedelta(hours=hours)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        sent = []
        for ts in rows["ts"]:
            ok = last is None or ts - last >= gap
            sent.append(ok)
            last = ts if ok else last
        state.update((str(last),))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"].to_numpy(), "sent": sent})

    return events.select("key", F.col("ts").cast("timestamp").alias("ts")).groupBy("key").applyInPandasWithState(step, "key long, ts timestamp, sent boolean", "last string", "append", GroupStateTimeout.NoTimeout)


def gated_tokens(pieces: DataFrame, sentinel: str) -> DataFrame:
    """A stream of (request, seq, piece) with what may be shown: pieces are held while they may still be the sentinel."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, is_open = state.get if state.exists else ("", False)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        shown = []
        for piece in rows["piece"]:
            if is_open:
                shown.append(piece)
                continue
            held += piece
            probe = held.strip().strip("`").strip()
            is_open = bool(probe) and not sentinel.startswith(probe)
            shown.append(held if is_open else "")
        state.update((held, is_open))
        yield pd.DataFrame({"request": key[0], "seq": rows["seq"].to_numpy(), "shown": shown})

    return pieces.groupBy("request").applyInPandasWithState(step, "request long, seq long, shown string", "held string, is_open boolean", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, written to folder and read back. The folder has to be one that every executor sees."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def frames(pieces: DataFrame) -> DataFrame:
    """A stream of (request, seq, piece) with the event frames they make up: (request, n, kind, data), n from 0 in each request.

    A frame ends with an empty line and may be cut anywhere, within that line too; what is no whole frame yet is kept for the
    pieces to come. Lines "event: " name the kind, message without one; the rests of lines "data: " are joined; frames
    without data are nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        *whole, held = (held + "".join(rows["piece"].dropna())).split("\n\n")
        out = []
        for frame in whole:
            kind, data = "message", ""
            for line in frame.split("\n"):
                if line.startswith("event: "):
                    kind = line[len("event: ") :]
                elif line.startswith("data: "):
                    data += line[len("data: ") :]
            if data:
                out.append((key[0], n, kind, data))
                n += 1
        state.update((held, n))
        yield pd.DataFrame(out, columns=["request", "n", "kind", "data"])

    return pieces.groupBy("request").applyInPandasWithState(step, "request long, n long, kind string, data string", "held string, n long", "append", GroupStateTimeout.NoTimeout)


def backoff(attempt: int, key: object, base: float = 2.0, jitter: float = 1.0) -> float:
    """Seconds to wait after a failed attempt: base doubled with each, and a share of jitter that a hash of key and attempt fixes."""
    share = int(hashlib.md5(f"{key}:{attempt}".encode()).hexdigest()[:8], 16) / 2**32
    return base * 2 ** (attempt - 1) + jitter * share


def attempts(results: DataFrame, most: int = 3, base: float = 2.0, jitter: float = 1.0) -> DataFrame:
    """A stream of a source's results (source, seq, ok) with what follows: (source, seq, attempt, state, wait).

    state is done after a good result, retry with seconds to wait after a bad one, and failed after most bad ones in a row; after
    done and failed the next result is a first attempt again. Sources don't touch each other.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (failures,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for seq, ok in zip(rows["seq"], rows["ok"]):
            attempt = failures + 1
            done = "done" if ok else "failed" if attempt >= most else "retry"
            out.append((key[0], seq, attempt, done, round(backoff(attempt, key[0], base, jitter), 6) if done == "retry" else None))
            failures = attempt if done == "retry" else 0
        state.update((failures,))
        yield pd.DataFrame(out, columns=["source", "seq", "attempt", "state", "wait"]).astype({"wait": "float64"})

    return results.groupBy("source").applyInPandasWithState(step, "source long, seq long, attempt long, state string, wait double", "failures long", "append", GroupStateTimeout.NoTimeout)


def call_outcomes(begun: DataFrame, finished: DataFrame, within: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(request, began_at, state) of calls from streams begun and finished (request, ts): finished, or aborted where no end came within so long.

    A call counts from its first chunk, the first begun row of its request. Whether it was aborted is known once the watermark
    of both streams has passed the time by which it could have ended.
    """
    first = begun.select(F.col("request").alias("request"), F.col("ts").cast("timestamp").alias("began_at")).withWatermark("began_at", late).dropDuplicatesWithinWatermark(["request"])
    ends = finished.select(F.col("request").alias("of"), F.col("ts").cast("timestamp").alias("ended_at")).withWatermark("ended_at", late)
    met = (F.col("request") == F.col("of")) & (F.col("ended_at") >= F.col("began_at")) & (F.col("ended_at") <= F.col("began_at") + F.expr(f"interval {within}"))
    return first.join(ends, met, "left_outer").select("request", "began_at", F.when(F.col("of").isNull(), "aborted").otherwise("finished").alias("state"))


LEDGER = "fingerprint string, part string, batch long"


def record(batch: DataFrame, number: int, ledger: str) -> None:
    """Add the unseen fingerprints of a micro-batch to the ledger, a table by the first two digits and the batch's number.

    Only parts that the batch has fingerprints of are read (256 at most). A batch that is run again replaces what it wrote
    before, so it adds nothing twice.
    """
    spark = batch.sparkSession
    new = batch.select("fingerprint").where("fingerprint is not null").distinct().withColumn("part", F.lower(F.substring(F.hex(F.crc32("fingerprint")), -2, 2))).persist()  # read twice
    parts = [r.part for r in new.select("part").distinct().collect()]
    try:
        known = spark.read.schema(LEDGER).parquet(ledger).where(F.col("part").isin(parts) & (F.col("batch") != number))
    except AnalysisException:  # the ledger's folder is not there yet
        known = spark.createDataFrame([], LEDGER)
    unseen = new.join(known.select("fingerprint"), "fingerprint", "left_anti").withColumn("batch", F.lit(number).cast("long"))
    # a part is written by one task: every task with rows of every part would make a file for each
    unseen.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(ledger)
    new.unpersist()


def into_ledger(stream: DataFrame, ledger: str, folder: str):
    """Start a query that records each micro-batch's unseen fingerprints in the table ledger, and stops when all is read."""
    append = lambda batch, number: record(batch, number, ledger)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
