"""Benchmark decontamination: training texts are read through a suffix automaton of the test items."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.automaton import SuffixAutomaton
from weft.llm.common import arrow_rows, cut
from weft.llm.words import gram_hashes, groups, joined, lowered, separators, stretches, word_table

#: Words of a window; a shorter item is one window of all its words.
WINDOW = 10
#: Item words of one automaton. More items make more passes over the documents, each with the items that its hash deals it.
PASS_WORDS = 500_000
#: Words of an item that are kept together; longer items are cut into pieces that overlap by a window less one word.
PIECE_WORDS = 10_000
#: Up to so many spans and items of all texts together are broadcast after several passes.
BROADCAST_FOUND = 200_000
BATCH = 500
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORDS = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_BITS = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "n_words bigint, longest bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>, cleaned string"


class Items:
    """The automaton of some items (id, words), with the items of every window at the state that stands for it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        sequences = [[self.numbers.setdefault(w, len(self.numbers)) for w in words] for _, words in items]
        self.automaton = a = SuffixAutomaton(sequences)
        self.shortest = min((min(len(s), window) for s in sequences), default=window)
        self.whole: dict[int, set[str]] = {}  # by the state of a full window
        self.short: dict[int, dict[int, set[str]]] = {}  # by the state and length of a shorter item
        for (name, _), sequence in zip(items, sequences):
            state = matched = 0
            for number in sequence:
                state, matched = a.step(state, matched, number)
                if matched >= window:
                    self.whole.setdefault(self.state_of(state, window), set()).add(name)
            if len(sequence) < window:
                self.short.setdefault(self.state_of(state, len(sequence)), {}).setdefault(len(sequence), set()).add(name)
        self._shorter: dict[int, list[tuple[int, set[str]]]] = {}
        # pairs of neighbouring words (single words where an item has one): what a match of the shortest window consists of
        self.width = min(2, self.shortest)
        data = b"\n".join(b" ".join(words) for _, words in items)
        blob = np.frombuffer(data, np.uint8)
        starts, _, hashes = word_table(blob, WORDS)
        self.grams = np.unique(gram_hashes(hashes, self.width))
        self.slots = np.zeros(1 << _BITS, bool)
        self.slots[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def state_of(self, state: int, length: int) -> int:
        """The state that stands for the last length numbers of what state stands for."""
        a = self.automaton
        while a.length[a.link[state]] >= length:
            state = a.link[state]
        return state

    def shorter(self, state: int) -> list[tuple[int, set[str]]]:
        """Lengths and names of the short items that end where state's substrings end."""
        if (got := self._shorter.get(state)) is None:
            got, at = [], state
            while at > 0:
                got += self.short.get(at, {}).items()
                at = self.automaton.link[at]
            self._shorter[state] = got
        return got

    def known(self, grams: np.ndarray) -> np.ndarray:
        """Which hashes are those of a gram of the items."""
        out = self.slots[(grams >> np.uint64(64 - _BITS)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at) and len(self.grams):
            place = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
            out[at] = self.grams[place] == grams[at]
        return out

    def read(self, words: list[bytes]) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Longest match at the end of a window, hit stretches (merged, by place) and items of some neighbouring words."""
        step, window = self.automaton.step, self.window
        state = matched = longest = 0
        hits: list[tuple[int, int]] = []
        names: set[str] = set()
        for at, word in enumerate(words, 1):
            number = self.numbers.get(word)
            if number is None:
                state = matched = 0
                continue
            state, matched = step(state, matched, number)
            reach = 0
            if matched >= window:
                names |= self.whole[self.state_of(state, window)]
                reach = window
            if self.short:
                for length, ids in self.shorter(state):
                    if length <= matched:
                        names |= ids
                        reach = max(reach, length)
            if reach:
                longest, a = max(longest, matched), at - reach
                while hits and hits[-1][1] >= a:
                    a = min(a, hits.pop()[0])
                hits.append((a, at))
        return longest, hits, names


def read_texts(items: Items, texts: list[bytes]) -> Iterator[tuple[int, int, list[tuple[int, int]], set[str], bytes]]:
    """(words, longest match, hit stretches in words, items, text without the hit stretches) of each text.

    A match of at least the shortest window consists of pairs of words that the items have, so the automaton reads those
    stretches; between them its match is shorter than any window. It reads the words themselves, not their hashes.
    """
    blob, bounds = joined(texts)
    data = lowered(np.frombuffer(blob, np.uint8))
    starts, ends, hashes = word_table(data, WORDS)
    first = np.searchsorted(starts, bounds)
    small = data.tobytes()
    held: dict[int, list] = {}
    marked = items.known(gram_hashes(hashes, items.width))
    if items.width > 1:
        marked[first[1:-1][(first[1:-1] > 0) & (first[1:-1] <= len(marked))] - 1] = False  # pairs across texts
    for x, y in stretches(marked, max(1, items.shortest - items.width + 1)):
        cuts = [x, *[int(c) for c in first[np.searchsorted(first, x, "right") : np.searchsorted(first, y, "left")]], y]
        for a, b in zip(cuts, cuts[1:]):
            k = int(np.searchsorted(first, a, "right")) - 1
            b = min(b + items.width - 1, int(first[k + 1]))
            longest, hits, names = items.read([small[starts[i] : ends[i]] for i in range(a, b)])
            if hits:
                held.setdefault(k, []).append((longest, [(a - int(first[k]) + p, a - int(first[k]) + q) for p, q in hits], names))
    for k, text in enumerate(texts):
        found = held.get(k, [])
        spans = merged([s for _, hits, _ in found for s in hits])
        a, b, offset = int(first[k]), int(first[k + 1]), int(bounds[k])
        yield b - a, max((x for x, _, _ in found), default=0), spans, set().union(*(n for _, _, n in found)), without(text, spans, starts[a:b] - offset, ends[a:b] - offset) if spans else text


def without(text: bytes, spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> bytes:
    """text without the words of spans and what stands between them."""
    kept, at = [], 0
    for p, q in spans:
        kept.append(text[at : int(starts[p])])
        at = int(ends[q - 1])
    return b"".join([*kept, text[at:]])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_words(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, words, piece) of a benchmark (item_id, text): lower-cased words, long items in overlapping pieces; items without words are left out."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words.alias("words")).where("size(words) > 0")
    last = F.greatest(F.size("words") - window, F.lit(0))
    return own.withColumn("piece", F.explode(F.sequence(F.lit(0), last, F.lit(PIECE_WORDS)))).select("item", F.slice("words", F.col("piece") + 1, PIECE_WORDS + window - 1).alias("words"), "piece")


_loaded: dict[str, Items] = {}


def _items(name: str, held, window: int) -> Items:
    """The automaton of a broadcast list, built once for each Python worker; the one before is let go."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Items([(i, w.split(b" ")) for i, w in held.value], window)
    return _loaded[name]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, with_text: bool = False, pass_words: int = PASS_WORDS) -> DataFrame:
    """docs with n_words, longest, spans, items and, if asked, cleaned.

    A window is window consecutive words of an item of benchmark (item_id, text), or a shorter item as a whole. spans are the
    stretches of words (start, end) of a text that lie in occurrences of windows, items the ids, as text and sorted as text, of the
    items that have one of them, longest the longest match that ends where a window ends (0 without), cleaned the text without its
    spans. Words are compared exactly after A to Z are lower-cased; null texts have no words. Null item ids are the text "null";
    items that share an id count once. Items without words match nothing. Repeated rows are treated alike; other columns stay,
    but for the names given above. An empty table of either kind is allowed.

    Each pass broadcasts items of about pass_words words in all, which are counted first. One pass adds no shuffle; several read the
    documents once each, and what they find is gathered by a digest of the text.
    """
    spark = docs.sparkSession
    arrow_rows(spark, BATCH)
    added = [f.name for f in T.StructType.fromDDL(FOUND).fields]
    own = [c for c in docs.columns if c.lower() not in added]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([packed.schema["row"], *T.StructType.fromDDL(FOUND).fields])
    pieces = cut(item_words(benchmark, window))
    total = pieces.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    passes = 1 if total <= pass_words else -(-total * 5 // (4 * pass_words))
    deal = pieces.withColumn("pass", F.pmod(F.xxhash64("item", "piece"), F.lit(passes)))
    held = [spark.sparkContext.broadcast([(r.item, " ".join(r.words).encode()) for r in deal.where(F.col("pass") == k).toLocalIterator()]) for k in range(passes)]
    if passes == 1:
        out = packed.mapInArrow(_reader(held[0], window, packed.columns, with_text), schema)
    else:
        out = _gathered(packed, held, window, with_text, schema)
    return out.select("row.*", *[c for c in added if with_text or c != "cleaned"])


def _arrays(columns: dict, rows: list[tuple]) -> list[pa.Array]:
    n, longest, spans, names, cleaned = zip(*rows) if rows else ((),) * 5
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    listed = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], kind)
    return [*columns.values(), pa.array(n, pa.int64()), pa.array(longest, pa.int64()), listed, pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array(cleaned, pa.binary()).cast(pa.string())]


def _reader(held, window: int, columns: list[str], with_text: bool, found_only: bool = False):
    """Reads batches of (first column, text) through the automaton of a broadcast list; found_only leaves out what has no span."""
    name, out = uuid.uuid4().hex, [columns[0], *(f.name for f in T.StructType.fromDDL(FOUND).fields)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(name, held, window)
        for batch in batches:
            texts, rows = batch.column(1).cast(pa.binary()).to_pylist(), []
            for a, b in groups(texts):
                rows += [r if with_text else (*r[:4], None) for r in read_texts(items, texts[a:b])]
            first = batch.column(0)
            if found_only:
                at = [k for k, r in enumerate(rows) if r[2]]
                first, rows = first.take(pa.array(at, pa.int64())), [rows[k] for k in at]
            yield pa.RecordBatch.from_arrays(_arrays({columns[0]: first}, rows), out)

    return work


def _gathered(packed: DataFrame, held: list, window: int, with_text: bool, schema: T.StructType) -> DataFrame:
    """What several passes find. Each names texts by digest, copies once; few found texts are sent to the rows, more are joined."""
    keyed = packed.withColumn("key", F.sha2("text", 256))
    found_schema = T.StructType([T.StructField("key", T.StringType()), *T.StructType.fromDDL(FOUND).fields])
    found = None
    for k, part in enumerate(held):
        one = keyed.select("key", "text").mapInArrow(_reader(part, window, ["key"], False, True), found_schema).withColumn("pass", F.lit(k))
        found = one if found is None else found.unionAll(one)
    once = found.groupBy("key", "pass").agg(F.max(F.struct("longest", "spans", "items")).alias("f"))
    whole = cut(once.groupBy("key").agg(
        F.max("f.longest").alias("longest"), F.flatten(F.collect_list("f.spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("f.items"))).alias("items")))
    few = whole.agg(F.sum(F.size("spans") + F.size("items")), F.count("*")).first()
    whole = F.broadcast(whole) if sum(x or 0 for x in few) <= BROADCAST_FOUND else whole
    names_out = schema.names
    joined_up = keyed.join(whole, "key", "left").select("row", "text", "longest", "spans", "items")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column(1).cast(pa.binary()).to_pylist(), []
            longest, spans, names = (batch.column(c).to_pylist() for c in (2, 3, 4))
            for k, text in enumerate(texts):
                hits = merged([(x["start"], x["end"]) for x in spans[k] or ()])
                starts, ends, _ = word_table(lowered(np.frombuffer(text, np.uint8)), WORDS)
                rows.append((len(starts), longest[k] or 0, hits, names[k] or (), without(text, hits, starts, ends) if with_text else None))
            yield pa.RecordBatch.from_arrays(_arrays({"row": batch.column(0)}, rows), names_out)

    return joined_up.mapInArrow(work, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, length: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """docs without contaminated spans: text loses them where the longest match has length words or more; rows with a larger share of hit words than coverage go.

    Null texts stay null. Words between kept spans keep what separates them. See contamination() for matches and edge cases.
    """
    found = contamination(docs, benchmark, window, with_text=True)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    kept = found.where(hit <= coverage * F.col("n_words"))
    names = [f.name for f in T.StructType.fromDDL(FOUND).fields]
    clear = F.when(F.col("text").isNotNull() & (F.col("longest") >= length), F.col("cleaned")).otherwise(F.col("text"))
    return kept.withColumn("text", clear).select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])


def contamination_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    found = contamination(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def oracle() -> str:
    """DuckDB SQL of contamination_digests(), without an automaton: windows of every length joined by their words."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}')"
    return f"""with i as (select coalesce(cast(item_id as varchar), 'null') as item, {words} as w from benchmark),
size as (select item, w, least(len(w), {WINDOW}) as n from i where len(w) > 0),
win as materialized (select distinct item, n, array_to_string(w[s + 1 : s + n], ' ') as words from (select item, w, n, unnest(range(len(w) - n + 1)) as s from size)),
d as materialized (select row_number() over () as r, doc_id, {words} as w from documents),
dw as (select r, unnest(w) as word, generate_subscripts(w, 1) - 1 as s from d),
lines as (select r, s, n, list(word) over (partition by r, n order by s rows between current row and n - 1 following) as l from dw, (select distinct n from size)),
found as materialized (select distinct r, s, n, item from (select r, s, n, array_to_string(l, ' ') as words from lines where len(l) = n) join win using (n, words)),
hit as (select r, count(*) as n_hit from (select distinct r, unnest(range(s, s + n)) as at from found) group by 1),
its as (select r, count(*) as n_items, string_agg(item, ',' order by encode(item)) as items from (select distinct r, item from found) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join its using (r)"""
