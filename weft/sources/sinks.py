"""Sinks: fixtures as JSON lines, digests through an injected sender, sessions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_vectors(vectors: DataFrame, path: str) -> None:
    """vectors (id, embedding) as JSON lines, rounded to six places."""
    vectors.select("id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding")).write.mode("overwrite").json(path)


def write_ranks(ranks: DataFrame, path: str, constants: list[int], model: str) -> None:
    """ranks (qid, id, chunk_rank) as one map for each question, and a meta table of what they were made with beside it."""
    maps = ranks.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "chunk_rank")))).alias("ranks"))
    maps.write.mode("overwrite").json(f"{path}/ranks")
    meta = ranks.agg(F.countDistinct("qid").alias("n_questions"), F.count("*").alias("n_ranks"))
    meta.select("*", F.array(*map(F.lit, constants)).alias("constants"), F.lit(model).alias("model")).write.mode("overwrite").json(f"{path}/meta")


def deliver(digests: DataFrame, send: Callable[[str, list[str]], bool]) -> DataFrame:
    """(subscriber, ok) after send(subscriber, lines) for each row of digests (subscriber, lines); a sender that raises counts as not ok."""

    def run(batches):
        for batch in batches:
            done = []
            for subscriber, lines in zip(batch["subscriber"], batch["lines"]):
                try:
                    done.append(bool(send(subscriber, list(lines))))
                except Exception:  # noqa: BLE001  the sender is foreign code
                    done.append(False)
            yield batch[["subscriber"]].assign(ok=done)

    return digests.select("subscriber", "lines").mapInPandas(run, f"subscriber {digests.schema['subscriber'].dataType.simpleString()}, ok boolean")


def session_tail(messages: Column, n: int = 50) -> Column:
    """The last n messages of a session, array<struct<role, content, pending>>, without their volatile field."""
    tail = F.slice(messages, F.greatest(F.size(messages) - (n - 1), F.lit(1)), n)
    return F.transform(tail, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))


VERSIONS = "version string, at timestamp, tables array<string>, counts map<string, bigint>, digests map<string, string>"


def publish(tables: dict[str, DataFrame], path: str) -> str:
    """Write tables as one new version under path, seen by published() as a whole or not at all; returns the version's name.

    Every table is written to a folder of its version first. The row that names the version, with each table's count and digest, is
    appended last, so a run that fails on the way leaves no version. Vectors (arrays of float or double) are rounded to six places.
    """
    spark, version = next(iter(tables.values())).sparkSession, uuid.uuid4().hex
    counts, digests = {}, {}
    for name, df in tables.items():
        rounded = [c for c, kind in df.dtypes if kind in ("array<float>", "array<double>")]
        plain = df.withColumns({c: F.transform(F.col(f"`{c}`"), lambda x: F.round(x.cast("double"), 6)) for c in rounded})
        plain.write.parquet(f"{path}/{version}/{name}")
        counts[name], digests[name] = fingerprint(spark.read.schema(plain.schema).parquet(f"{path}/{version}/{name}"))
    row = spark.createDataFrame([(version, list(tables), counts, digests)], "version string, tables array<string>, counts map<string, bigint>, digests map<string, string>")
    row.select("version", F.current_timestamp().alias("at"), "tables", "counts", "digests").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def fingerprint(table: DataFrame) -> tuple[int, str]:
    """Rows of a table and a digest of them that no order of rows changes."""
    hashed = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns]))).cast("decimal(38,0)")
    n, total = table.agg(F.count("*"), F.coalesce(F.sum(hashed), F.lit(0))).first()
    return n, f"{int(total) % 2**64:016x}"


def published(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the last one if none is named. A table whose rows are not those that were published is an error."""
    rows = spark.read.schema(VERSIONS).parquet(f"{path}/versions")
    found = (rows.where(F.col("version") == version) if version else rows.orderBy(F.desc("at"), F.desc("version"))).first()
    if found is None:
        raise ValueError(f"{path} has no version {version or ''}".rstrip())
    out = {}
    for name in found.tables:
        table = spark.read.parquet(f"{path}/{found.version}/{name}")
        if fingerprint(table) != (found.counts[name], found.digests[name]):
            raise ValueError(f"{name} of version {found.version} is not what was published")
        out[name] = table
    return out
