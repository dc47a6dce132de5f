"""Periodic runs of words by factorisation, and texts in which each run keeps its first period."""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.automaton import SuffixAutomaton
from weft.llm.common import WORD_PATTERN, arrow_rows, whole_text
from weft.llm.words import gram_hashes, groups, joined, separators, stretches, word_table

#: A run has so many words, and so many times its period.
LEAST, TIMES = 24, 3
BATCH = 500
WORDS = separators((0x20, 0x20), (0x09, 0x0D))
_DOC = np.uint64(0xD6E8FEB86659FD93)


def factors(sequence: Sequence[int]) -> list[tuple[int, int, int]]:
    """(start, length, source) of the Lempel-Ziv factors: each the longest stretch that also starts earlier, at source, or one new number (source -1).

    An earlier occurrence may overlap its factor. Found by walking the suffix automaton while the first place where a state's
    substrings end is left of where the factor now ends.
    """
    automaton = SuffixAutomaton([sequence])
    goes, first = automaton.next, automaton.first
    out, at, n = [], 0, len(sequence)
    while at < n:
        state, to = 0, at
        while to < n:
            ahead = goes[state][sequence[to]]
            if first[ahead] >= to:
                break
            state, to = ahead, to + 1
        if to == at:
            out.append((at, 1, -1))
            at += 1
        else:
            out.append((at, to - at, first[state] - (to - at) + 1))
            at = to
    return out


def prefix_matches(s: Sequence[int]) -> list[int]:
    """For each place how many numbers from it on are those that s begins with."""
    n = len(s)
    out = [0] * n
    left = right = 0
    for i in range(1, n):
        k = out[i - left] if i < right else 0
        if i + k >= right:
            k = max(right - i, 0) if i < right else 0
            while i + k < n and s[i + k] == s[k]:
                k += 1
            left, right = i, i + k
        out[i] = k
    return out


def crossing(s: Sequence[int], start: int, length: int, before: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs that hold the first number of a factor and end within it; before is the length of the factor before.

    Main's argument: the second period of such a run begins within the factor before or later, as otherwise that factor would be
    longer. So it begins after start - before, its period is at most (length + before) / (times - 1), and it starts no further left
    than reach. Extensions to both sides come from matches with the beginnings of the factor and of the reversed text before it.
    """
    longest = length + before + (length + before) // (times - 1)
    if longest < least:
        return
    end = start + length
    reach = min(start, before + (length + before) // (times - 1) + 1)
    factor, back = list(s[start:end]), list(s[start - reach : start][::-1])
    forward = prefix_matches([*factor, -1, *back[::-1], *factor])
    behind = prefix_matches([*back, -1, *factor[::-1], *back])
    for period in range(1, max(length, reach + 1)):
        if period < length:  # against the number a period later
            right, left = forward[period], behind[reach + 1 + length - period] if reach else 0
            if right and left + period + right >= max(least, times * period):
                yield from _ended(s, start - left, start + period + right, period, end)
        if period <= reach:  # against the number a period earlier
            right, left = min(forward[length + 1 + reach - period], length), behind[period] if period < reach else 0
            if right and left + period + right >= max(least, times * period):
                yield from _ended(s, start - period - left, start + right, period, end)


def _ended(s: Sequence[int], a: int, b: int, period: int, end: int) -> Iterator[tuple[int, int, int]]:
    """A run from a to b, unless it goes on beyond the factor's end; then it ends in a later factor."""
    if b >= end and b < len(s) and s[b] == s[b - period]:
        return
    while a > 0 and s[a - 1] == s[a - 1 + period]:  # reach never binds for a run that is long enough
        a -= 1
    yield a, b - a, period


def runs(s: Sequence[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of s by start and period: smallest period, at least least and times periods long.

    Kolpakov and Kucherov: s is cut into Lempel-Ziv factors. A run ends in some factor; if it starts at or before that factor's
    first number, crossing() finds it; if it starts inside, the same run starts at the same place of the factor's earlier occurrence
    and is copied from there. times is at least two.
    """
    found: dict[tuple[int, int], int] = {}
    order: list[tuple[int, int]] = []  # (start, length) of what is found, by start

    def keep(a: int, length: int, period: int) -> None:
        if (old := found.get((a, length))) is None:
            bisect.insort(order, (a, length))
            found[a, length] = period
        elif period < old:
            found[a, length] = period

    before = 0
    for start, length, source in factors(s):
        if source >= 0:
            end = start + length
            for run in crossing(s, start, length, before, least, times):
                keep(*run)
            shift = start - source
            k = bisect.bisect_left(order, (source + 1, 0))
            while k < len(order) and order[k][0] + shift < end:  # copies start later than their originals
                a, size = order[k]
                period = found[a, size]
                b = min(a + size + shift, end)
                if b - a - shift >= max(least, times * period) and not (b == end < len(s) and s[b] == s[b - period]):
                    keep(a + shift, b - a - shift, period)
                k += 1
        before = length
    return sorted((a, length, period) for (a, length), period in found.items())


def gram_width(least: int, times: int) -> int:
    """The largest width for which every group of so many neighbouring words within a run is there at least twice."""
    return max(1, min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 2)))


def folded(n: int, draw: int) -> tuple[int, int] | None:
    """Where and with which period the words of a text of n words are repeated by draw, a checksum of its id; None for the texts left as they are."""
    if draw % 10 or not n:
        return None
    a = draw // 10 % n
    return a, 1 + (n - a) // (3 + draw // 10 % 8)


def text_runs(texts: list[bytes], draws: list[int | None], least: int, times: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs of each text and its words, joined by one space, without what repeats a run's first period.

    Words are compared as they are; only stretches in which every group of gram_width() neighbouring words is there twice in the
    text can hold a run, so only those are factorised.
    """
    width = gram_width(least, times)
    blob, bounds = joined(texts)
    starts, ends, hashes = word_table(np.frombuffer(blob, np.uint8), WORDS)
    first = np.searchsorted(starts, bounds)
    order, plain = np.arange(len(starts)), [True] * len(texts)
    for k, draw in enumerate(draws):
        a, b = int(first[k]), int(first[k + 1])
        if draw is not None and (fold := folded(b - a, draw)):
            order[a + fold[0] : b] = a + fold[0] + np.arange(b - a - fold[0]) % fold[1]
            plain[k] = False
    grams = gram_hashes(hashes[order], width)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    repeated = np.zeros(len(starts) + 1, bool)
    if len(grams):
        own = text[: len(grams)] == text[width - 1 :]
        places = np.flatnonzero(own)
        keys = grams[places] ^ (text[places].astype(np.uint64) * _DOC)
        sort = np.argsort(keys)
        same = keys[sort][1:] == keys[sort][:-1]
        repeated[places[sort[1:][same]]] = repeated[places[sort[:-1][same]]] = True
    held: dict[int, list[tuple[int, int, int]]] = {}
    numbers: dict[bytes, int] = {}
    word = lambda i: blob[starts[i] : ends[i]]
    enough = max(1, least - width + 1)
    for a, b in stretches(repeated, enough):
        cuts = [a, *[int(x) for x in first[np.searchsorted(first, a, "right") : np.searchsorted(first, b, "left")]], b]
        for x, y in zip(cuts, cuts[1:]):
            if y - x < enough:
                continue
            k = int(text[x])
            s = [numbers.setdefault(word(i), len(numbers)) for i in order[x : min(y + width - 1, int(first[k + 1]))]]
            held.setdefault(k, []).extend((x - int(first[k]) + p, length, period) for p, length, period in runs(s, least, times))
    for k, t in enumerate(texts):
        mine = sorted(held.get(k, []), key=lambda r: (r[0], r[2]))
        if plain[k] and not mine:
            yield mine, b" ".join(t.split())
            continue
        a, b = int(first[k]), int(first[k + 1])
        keep = np.ones(b - a, bool)
        for p, length, period in mine:
            keep[p + period : p + length] = False
        yield mine, b" ".join([word(i) for i in order[a:b][keep]])


def collapse(docs: DataFrame, draw: Column | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with runs (array of start, length, period, by start and period) and collapsed, the words that no run repeats, joined by one space.

    A run is a maximal stretch of words with smallest period q, of at least least words and times * q; words are numbered from 0.
    draw, if given, is a number for each row from which folded() derives a repetition of the text's own words, done first; null does
    none. Null texts are empty and have no runs; repeated rows are treated alike; other columns stay as they are, whatever their
    names but runs and collapsed, which are replaced; an empty table gives an empty result. Memory grows with one Arrow batch, and
    with the longest stretch of one text that repeats itself.
    """
    arrow_rows(docs.sparkSession, BATCH)
    kept = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), whole_text().alias("text"), (F.lit(None) if draw is None else draw).cast("long").alias("draw"))
    schema = T.StructType([packed.schema["row"], *T.StructType.fromDDL("runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            texts, draws = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
            found, out = [], []
            for a, b in groups(texts):
                for r, t in text_runs(texts[a:b], draws[a:b], least, times):
                    found.append([dict(zip(("start", "length", "period"), x)) for x in r])
                    out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, shape), pa.array(out, pa.binary()).cast(pa.string())], ["row", "runs", "collapsed"])

    return packed.mapInArrow(work, schema).select("row.*", "runs", "collapsed")


def run_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of docs whose words are repeated by the crc32 of their id.

    start to exponent_milli are of the run with the largest length / period, ties by start and period; null where there is none.
    A null doc_id repeats nothing.
    """
    rows = collapse(docs.select("doc_id", "text"), F.crc32(F.col("doc_id").cast("long").cast("string"))).drop("text")
    # lengths and periods are compared as fractions, crosswise
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return rows.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def oracle() -> str:
    """DuckDB SQL of run_digests(): pairs of equal words a period apart, in islands."""
    return f"""with recursive bits as (select i, i as c, 0 as k from (select unnest(range(256)) as i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
tab as (select list(c order by i) as tab from bits where k = 8),
ids as (select distinct doc_id, cast(doc_id as varchar) as s from documents where doc_id is not null),
crc as (select doc_id, s, 0 as k, 4294967295::bigint as c from ids union all select doc_id, s, k + 1, xor(c >> 8, tab[(xor(c, ascii(substr(s, k + 1, 1))::bigint) & 255) + 1]) from crc, tab where k < length(s)),
h as (select doc_id, xor(c, 4294967295) as h from crc where k = length(s)),
d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}') as w, len(w) as n from documents),
f as materialized (select r, doc_id, w, n, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a, case when h % 10 = 0 and n > 0 then 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) end as p from d left join h using (doc_id)),
own as materialized (select r, a, p, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from f),
word as materialized (select x.r, x.i, y.word from own x join own y on y.r = x.r and y.i = case when x.a is not null and x.i >= x.a then x.a + (x.i - x.a) % x.p else x.i end),
pairs as (select x.r, x.i, y.i - x.i as q from word x join word y on x.r = y.r and x.word = y.word and y.i > x.i join f on f.r = x.r where (y.i - x.i) * {TIMES} <= f.n),
island as (select r, q, min(i) as start, count(*) + q as length from (select r, q, i, i - row_number() over (partition by r, q order by i) as g from pairs) group by r, q, g having count(*) + q >= greatest({LEAST}, {TIMES} * q)),
run as materialized (select r, start, length, min(q) as period from island group by all),
kept as (select r, i, word from word where not exists (select 1 from run where run.r = word.r and word.i >= run.start + run.period and word.i < run.start + run.length)),
texts as (select r, string_agg(word, ' ' order by i) as t from kept group by 1),
best as (select r, start, length, period from (select *, row_number() over (partition by r order by length / period desc, start, period) as place from run) where place = 1),
lists as (select r, count(*) as n, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as s from run group by 1)
select doc_id, coalesce(lists.n, 0) as n_runs, start::bigint as start, length::bigint as length, period::bigint as period, (1000 * length // period)::bigint as exponent_milli, sha256(coalesce(lists.s, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from f left join texts using (r) left join lists using (r) left join best using (r)"""
