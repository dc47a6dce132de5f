"""Bounded fetching of web sources with an injected client: redirects resolved, sizes and times limited, failures as rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft import vocab
from weft.functions import text

FETCHED = "request bigint, place int, uri string, url string, payload string, error string"
TITLE_CAP = 300


def resolved(resolve: Callable[[str, str, float], str], uri: str, seconds: float) -> str | None:
    """The real address of uri: asked by HEAD, and by GET where that fails."""
    for method in ("HEAD", "GET"):
        try:
            return resolve(method, uri, seconds)
        except Exception:  # noqa: BLE001  the client is foreign code
            continue
    return None


def _body(chunks: Iterable[bytes], most: int, until: float) -> str:
    out, size = [], 0
    for chunk in chunks:
        if time.monotonic() > until:
            raise TimeoutError("too slow")
        out.append(chunk[: most - size])
        size += len(out[-1])
        if size >= most:
            break
    return b"".join(out).decode("utf-8", "replace")


def fetched(
    requests: DataFrame, resolve: Callable[[str, str, float], str], fetch: Callable[[str, float], Iterable[bytes]],
    limit: int = 3, seconds: float = 6.0, most_bytes: int = 2_000_000, workers: int = 8,
) -> DataFrame:
    """(request, place, uri, url, payload, error) of the first limit addresses of each request, by place; requests (request, place, uri).

    resolve(method, uri, seconds) gives the real address, fetch(url, seconds) the body in chunks; they may raise. Up to workers
    addresses of a partition are under way at once; a body is cut at most_bytes, and one that isn't there after seconds is an
    error. An address that does not resolve, or fails, becomes a row with error and stops no other. Empty addresses don't count.
    """
    wanted = requests.where(F.coalesce("uri", F.lit("")) != "")
    wanted = wanted.withColumn("n", F.row_number().over(Window.partitionBy("request").orderBy("place"))).where(F.col("n") <= limit)

    def one(uri: str) -> tuple[str | None, str | None, str | None]:
        until = time.monotonic() + seconds
        url = resolved(resolve, uri, seconds)
        if not url:
            return None, None, "unresolved"
        try:
            return url, _body(fetch(url, max(0.0, until - time.monotonic())), most_bytes, until), None
        except Exception as e:  # noqa: BLE001  the client is foreign code
            return url, None, type(e).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(workers)
        try:
            for batch in batches:
                for at in range(0, len(batch), workers):
                    part = batch.iloc[at : at + workers]
                    begun = [(pool.submit(one, uri), time.monotonic() + seconds) for uri in part["uri"]]
                    rows = []
                    for future, until in begun:
                        try:
                            rows.append(future.result(max(0.0, until - time.monotonic())))
                        except Late:
                            rows.append((None, None, "TimeoutError"))
                    yield part.assign(**dict(zip(("url", "payload", "error"), map(list, zip(*rows)))))
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return wanted.select(F.col("request").cast("bigint").alias("request"), F.col("place").cast("int").alias("place"), "uri").mapInPandas(run, FETCHED)


def web_sources(pages: DataFrame, cap: int = vocab.CONTENT_CAP) -> DataFrame:
    """(request, place, uri, title, text) of fetched pages that have text, numbered anew in their order; the address is the title of a page without one."""
    shown = text.html_text(F.regexp_replace("payload", "(?is)<title\\b[^>]*>.*?</title\\s*>", " "), cap)
    title = text.html_text(F.regexp_extract("payload", "(?is)<title\\b[^>]*>(.*?)</title\\s*>", 1), TITLE_CAP)
    good = pages.where("error is null").select("request", "place", F.col("url").alias("uri"), F.coalesce(F.nullif(title, F.lit("")), F.substring("url", 1, TITLE_CAP)).alias("title"), shown.alias("text")).where("text != ''")
    return good.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy("place")))
