"""Language-model scoring: causal attention over subword ids trained on all training texts, word counts joined in shards."""

from __future__ import annotations

import base64
import contextlib
import gc
import itertools
import pickle
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.attention import DENSE, Attention, score
from weft.llm.common import arrow_rows, cut, partitions, whole_text
from weft.llm.quality import row_key
from weft.llm.words import Grown, Numbering

VOCABULARY_FILE = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Classes of ids that the attention tells apart, half of them of ids that start words; the end is one more.
CLASSES = 16
#: Share of one count that a known word leaves to the unknown word of its classes.
DISCOUNT = 0.75
#: Every task knows the counts of words that are at least one in FREQUENT tokens, so of no more words than that; other words are joined.
FREQUENT = 131_072
#: Words whose hash and ids a task keeps from batch to batch.
KEPT_WORDS = 500_000
#: Distinct words of a shard of the counts, and words that a task hands on at once.
SHARD_WORDS, HELD_WORDS = 500_000, 300_000
#: Training texts that one shard learns from, and that it takes at a time.
SHARD_TEXTS, TEXTS_AT_ONCE = 8_192, 256
#: Rows of the embeddings that one row of a model's parts holds.
ROWS = 4096
END = b""


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null"))) % 5 == 1


def tokens(text: str) -> list[bytes]:
    """Lower-cased words and one end, which is the empty word."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def word_hash(word: bytes) -> int:
    """Signed XXH64; words are joined by it."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


@lru_cache(2)
def vocabulary(path: str) -> dict[bytes, int]:
    """Pieces of a tiktoken file that have no space but at their start, by id; every byte is one of them."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return {p: i for p, i in ranks.items() if b" " not in p[1:]}


def classes_of(first: np.ndarray) -> np.ndarray:
    """A class for each id but the end: those that start words and others apart, each by the logarithm of its place in the vocabulary's order of merges."""
    out = np.zeros(len(first), np.int64)
    for side, low, n in ((True, 0, CLASSES // 2), (False, CLASSES // 2, CLASSES - CLASSES // 2)):
        mine = np.flatnonzero(first == side)
        out[mine] = low + np.minimum(np.log1p(np.arange(len(mine))) / np.log1p(len(mine)) * n, n - 1).astype(np.int64)
    return out


class Pieces(NamedTuple):
    """What longest-piece segmentation needs of a vocabulary: its size with the end, the automaton, which ids start words, and the classes."""

    n: int
    longest: ahocorasick.Automaton
    first: np.ndarray
    of_class: np.ndarray


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """Built once for each worker process."""
    ids = vocabulary(path)
    n, longest = max(ids.values()) + 2, ahocorasick.Automaton()
    first = np.zeros(n, bool)
    for piece, i in ids.items():
        longest.add_word(piece.decode("latin-1"), i)
        first[i] = piece[:1] == b" "
    longest.make_automaton()
    return Pieces(n, longest, first, np.r_[classes_of(first[:-1]), CLASSES])


class Segments:
    """Subword ids of words: of a space and the word, always the longest piece next. Words are numbered as they come, the end first.

    hashes tell words apart, kinds the sequences of classes of their ids.
    """

    def __init__(self, path: str):
        self.n, self.longest, self.first, self.of_class = pieces(path)  # the last id is the end
        self.clear()

    def clear(self) -> None:
        self.number = Numbering({END: 0})
        self._ids, self._sizes, self._starts, self._hashes, self._kinds = (Grown([x]) for x in (self.n - 1, 1, 0, word_hash(END), 0))

    ids, sizes, starts, hashes, kinds = (property(lambda self, x=x: getattr(self, x).held) for x in ("_ids", "_sizes", "_starts", "_hashes", "_kinds"))

    def add(self, new: list[bytes]) -> None:
        """What is known of the words that were numbered last, in their order."""
        found = np.fromiter((i for _, i in self.longest.iter_long((b" " + b" ".join(new)).decode("latin-1"))), np.int64)
        starts = np.flatnonzero(self.first[found])
        sizes = np.diff(np.r_[starts, len(found)])
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(max(sizes) + 1, 0x9E3779B97F4A7C15, np.uint64))
            place = np.arange(len(found)) - np.repeat(starts, sizes)
            kinds = np.add.reduceat((self.of_class[found] + 1).astype(np.uint64) * powers[place], starts)
            kinds = (kinds ^ (kinds >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(w, 42) for w in new]), ">i8").astype(np.int64)
        for grown, more in ((self._starts, starts + len(self.ids)), (self._sizes, sizes), (self._hashes, hashes), (self._kinds, kinds.view(np.int64)), (self._ids, found)):
            grown.add(more)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words, known or new."""
        before = len(self.number)
        out = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if more := len(self.number) - before:
            self.add(list(itertools.islice(reversed(self.number), more))[::-1])
        return out

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words one after another, ids of each word)."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - ends + sizes, sizes)], sizes


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


class Sequences(NamedTuple):
    """Texts one after another: numbers of their tokens, tokens of each text, input and target ids, ids of each text."""

    numbers: np.ndarray
    n_tokens: np.ndarray
    inputs: np.ndarray
    targets: np.ndarray
    sizes: np.ndarray


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """No search for cyclic garbage meanwhile: many small objects are made that hold no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


@uncollected()
def sequences(known: Segments, texts: list[str]) -> Sequences:
    split = [tokens(t) for t in texts]
    n_tokens = np.array([len(t) for t in split], np.int64)
    numbers = known.numbers(list(itertools.chain.from_iterable(split)))
    ids, of_word = known.of(numbers)
    sizes = np.add.reduceat(of_word, np.r_[0, np.cumsum(n_tokens)[:-1]])
    inputs = np.r_[known.n, ids[:-1]]
    inputs[np.r_[0, np.cumsum(sizes)[:-1]]] = known.n
    return Sequences(numbers, n_tokens, inputs, ids, sizes)


ROWS_OF_TEXT = pa.schema([("text", pa.string()), ("k", pa.int64())])
NAMES = ["h", "kind", "c", "part", "data"]


def learned(docs: DataFrame, path: str) -> tuple[DataFrame, Attention]:
    """(h, kind, c): counts of the words of docs (text, k), the end among them, and the model trained on all of docs.

    Texts are dealt to shards by k, a hash of the row, and taken in its order; the number of shards follows from that of the texts
    alone, so the model does not depend on how Spark splits docs. Every shard starts from the same model, learns from all
    windows of its texts once and counts its words. The model's parts are averaged over shards: dense ones by windows,
    an input's row by how often it was met.
    """
    n = Segments(path).n
    many = max(1, -(-docs.count() // SHARD_TEXTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = Segments(path), Attention(n, CLASSES + 1)
        held, ready = np.zeros(1, np.int64), []
        table = pa.Table.from_batches((pa.RecordBatch.from_arrays(b.columns, schema=ROWS_OF_TEXT) for b in batches), schema=ROWS_OF_TEXT).sort_by([("k", "ascending"), ("text", "ascending")])

        def words() -> pa.RecordBatch:
            at = np.flatnonzero(held)
            none = pa.nulls(len(at), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(known.hashes[at]), pa.array(known.kinds[at]), pa.array(held[at]), pa.nulls(len(at), pa.int32()), none], NAMES)

        def texts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            nonlocal held
            for at in range(0, table.num_rows, TEXTS_AT_ONCE):
                if len(known.number) > KEPT_WORDS:
                    ready.append(words())
                    known.clear()
                    held = np.zeros(1, np.int64)
                s = sequences(known, table["text"].slice(at, TEXTS_AT_ONCE).to_pylist())
                add = np.bincount(s.numbers, minlength=len(held))
                add[: len(held)] += held
                held = add
                yield s.inputs, known.of_class[s.targets], s.sizes

        met, windows = model.learn(texts())
        yield from ready
        yield words()
        if not windows:
            return
        rows = [(-1, _pack(np.concatenate([model.p[k].ravel() for k in DENSE]).astype(np.float64) * windows, np.array([windows])))]
        for at in range(0, n + 1, ROWS):
            m = met[at : at + ROWS]
            if m.any():
                rows.append((at // ROWS, _pack(model.p["e"][at : at + ROWS] * m[:, None].astype(np.float32), m)))
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], NAMES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, data in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = _unpack(data)
                old = sums.get(part)
                sums[part] = (a.astype(np.float64), b) if old is None else (old[0] + a, old[1] + b)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_pack(*x) for x in sums.values()], pa.binary())], ["part", "data"])

    spark = docs.sparkSession
    arrow_rows(spark, 256)
    texts = docs.select(whole_text().alias("text"), "k")
    found = cut(texts.repartitionById(many, F.pmod("k", F.lit(many)).cast("int")).mapInArrow(run, "h long, kind long, c long, part int, data binary"))
    parts = found.where("part is not null").select("part", "data").repartition(partitions(spark), "part").mapInArrow(add, "part int, data binary")
    model = Attention(n, CLASSES + 1)
    for r in parts.collect():  # as many rows as the model has parts
        a, b = _unpack(r.data)
        if r.part < 0:
            flat, at = a / b[0], 0
            for k in DENSE:
                size = model.p[k].size
                model.p[k], at = flat[at : at + size].reshape(model.p[k].shape).astype(np.float32), at + size
        else:
            rows = np.flatnonzero(b)
            model.p["e"][r.part * ROWS + rows] = a[rows] / b[rows, None]
    return found.where("part is null").groupBy("h", "kind").agg(F.sum("c").alias("c")), model


def within(c: np.ndarray, total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Log10 chance of words of count c among those of their sequence of classes, which have so many tokens and words in training.

    Absolute discounting: what the known words leave is the chance of the one unknown word of these classes.
    """
    held = np.where(c > 0, c - DISCOUNT, np.where(total > 0, DISCOUNT * words, 1.0))
    return np.log10(held / np.maximum(total, 1))


def base_chances(c: np.ndarray, tokens: int, distinct: int) -> np.ndarray:
    return np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))


def score_documents(docs: DataFrame, vocabulary_file: str = VOCABULARY_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Tokens are lower-cased words and one end. Documents whose CRC-32 of the id as text leaves 1 by 5 are held out;
    all the others are learned from, whole. base_score is the sum over tokens of log10((c + 0.5) / (N + 0.5 (V + 1))).

    score is the model's log10 probability of the text, the product over its words and its end. The subword ids of a word
    are the public vocabulary's longest pieces from its start; single bytes are pieces, so every word has ids. A causal
    attention model over the sequence of ids gives the chance of each next id's class; windows of ids overlap and score
    each id once. Times these, a word has its chance among the training words of the same sequence of classes, by its
    count. Words without a count are the one unknown word of their classes, as base_score has one in all.

    Every shard of the training texts trains on all of its windows, and the models are averaged (learned()), so what
    is learned from grows with the corpus, while the model keeps its size. Shards are fixed by a hash of id and text. Words of at least one in FREQUENT
    tokens are known to every task; the other words of a document meet the counts in shards by hash. Words with equal
    64-bit hashes would share a count, and so would sequences of classes. A very long text costs in proportion to its length, in one task.

    Null text is empty; a null id counts as the text "null". Repeated rows are scored alike and kept. Without
    training documents N is 0 and the attention is as initialised. An empty table gives an empty result; other columns
    are ignored.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 256)
    base_rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), row_key(id_col, text_col).alias("k"), is_held_out(id_col).alias("held_out"))
    training = base_rows.where(~F.col("held_out")).select("text", "k")
    counts, model = learned(training, vocabulary_file)
    counts = cut(counts)
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, distinct = whole.n, whole.v
    frequent = counts.where((F.col("c") * FREQUENT >= n_all) | (F.col("h") == word_hash(END)))
    of_kind = counts.join(F.broadcast(frequent.select("kind").distinct()), "kind", "left_semi").groupBy("kind").agg(F.sum("c").alias("total"), F.count("*").alias("words"))
    listed = sorted((r.h, r.c, r.total, r.words) for r in frequent.join(of_kind, "kind").collect()) or [(word_hash(END), 0, 0, 0)]
    known_hashes, known_counts, known_totals, known_words = (np.array(x, np.int64) for x in zip(*listed))
    shards = max(8, -(-distinct // SHARD_WORDS))
    schema = "shard int, kind int, data binary"

    def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["shard", "kind", "data"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tables = Segments(vocabulary_file), model.tables()
        for batch in batches:
            if not batch.num_rows:
                continue
            if len(known.number) > KEPT_WORDS:
                known.clear()
            s = sequences(known, batch.column("text").to_pylist())
            logs = score(tables, s.inputs, known.of_class[s.targets], s.sizes) / np.log(10)
            seen = np.flatnonzero(np.bincount(s.numbers))
            flat = np.cumsum(np.bincount(s.numbers) > 0)[s.numbers] - 1
            h = known.hashes[seen]
            at = np.minimum(np.searchsorted(known_hashes, h), len(known_hashes) - 1)
            held = known_hashes[at] == h
            c, total, words = (np.where(held, x[at], 0) for x in (known_counts, known_totals, known_words))
            owner = np.repeat(np.arange(len(s.n_tokens)), s.n_tokens)
            here = held[flat]
            sum_of = lambda v: np.bincount(owner[here], v[flat[here]], minlength=len(s.n_tokens))
            base, n_known = sum_of(base_chances(c, n_all, distinct)), sum_of((c > 0).astype(float)).astype(np.int64)
            logs = logs + sum_of(np.where(h == word_hash(END), 0.0, within(c, total, words)))  # the end is alone in its class
            k, ids = np.array(batch.column("k")), batch.column("doc_id")
            rows = [(int(k[0] % shards), 2, _pack(k, np.array(ids.fill_null(0)), np.array(ids.is_null()), np.array(batch.column("held_out")), s.n_tokens, base, n_known, logs))]
            pairs, times = np.unique(owner[~here] * len(seen) + flat[~here], return_counts=True)
            who, what = pairs // len(seen), pairs % len(seen)
            kinds = known.kinds[seen[what]]
            shard = kinds % shards
            for x in np.unique(shard):
                at = shard == x
                rows.append((int(x), 1, _pack(k, who[at].astype(np.uint32), h[what[at]], kinds[at], times[at].astype(np.uint32))))
            yield batch_of(rows)

    class Shard:
        """The words of some sequences of classes, with their counts and those of their sequences."""

        def __init__(self, parts: list[tuple[np.ndarray, ...]]):
            hashes, kinds, counts = (np.concatenate(x) for x in zip(*parts)) if parts else np.empty((3, 0), np.int64)
            order = np.argsort(hashes)
            self.hashes, self.counts = hashes[order], counts[order]
            self.kinds, at = np.unique(kinds, return_inverse=True)
            self.totals, self.words = np.bincount(at, counts, len(self.kinds)), np.bincount(at, minlength=len(self.kinds))

        def of(self, h: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if not len(self.hashes):
                return (np.zeros(len(h), np.int64),) * 3
            at, k = (np.minimum(np.searchsorted(x, y), len(x) - 1) for x, y in ((self.hashes, h), (self.kinds, kinds)))
            there = self.kinds[k] == kinds
            return np.where(self.hashes[at] == h, self.counts[at], 0), np.where(there, self.totals[k], 0), np.where(there, self.words[k], 0)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ready, parts = None, Shard([]), []
        names = ["k", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "copies"]
        for batch in batches:
            for shard, kind, data in zip(*(x.to_pylist() for x in batch.columns)):
                if shard != at:
                    at, ready, parts = shard, Shard([]), []
                got = _unpack(data)
                if kind == 0:
                    parts.append(got)
                    continue
                if parts:
                    ready, parts = Shard(parts), []
                if kind == 2:
                    k, ids, null, held, sizes, base, known, logs = got
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(ids, mask=null), pa.array(held), pa.array(sizes), pa.array(known), pa.array(base), pa.array(logs), pa.array(np.ones(len(k), np.int64))], names)
                    continue
                k, who, h, kinds, times = got
                c, total, words = ready.of(h, kinds)
                rows, index = np.unique(who, return_inverse=True)
                base, logs, known = (np.bincount(index, x * times) for x in (base_chances(c, n_all, distinct), within(c, total, words), (c > 0).astype(float)))
                none = pa.nulls(len(rows), pa.int64())
                zero = pa.array(np.zeros(len(rows), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(k[rows]), none, pa.nulls(len(rows), pa.bool_()), zero, pa.array(known.astype(np.int64)), pa.array(base), pa.array(logs), zero], names)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            shard = columns[1] % shards
            return batch_of([(int(x), 0, _pack(*[c[shard == x] for c in columns])) for x in np.unique(shard)])

        for batch in batches:
            if batch.num_rows:
                held.append([np.array(c) for c in batch.columns])
            if sum(len(x[0]) for x in held) >= HELD_WORDS:
                yield out()
        if held:
            yield out()

    asked, rare = base_rows.mapInArrow(ask, schema), counts.select("h", "kind", "c").mapInArrow(hold, schema)
    met = asked.union(rare).repartition(max(shards, partitions(spark)), "shard").sortWithinPartitions("shard", "kind")
    parts = met.mapInArrow(answer, "k long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, copies long")
    summed = parts.groupBy("k").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score", "copies")])
    each = lambda c: F.col(c) / F.col("copies")  # noqa: E731  rows of equal id and text were summed
    return summed.select(
        "doc_id", "held_out", each("n_tokens").cast("long").alias("n_tokens"), each("n_known").cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        each("base_score").alias("base_score"), each("score").alias("score"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
