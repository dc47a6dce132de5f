"""Quality classifier: perplexity under a modified Kneser-Ney trigram model of trusted text, by sharded count joins."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import arrow_rows, cut, free, partitions, whole_text

#: Words of the closed vocabulary, by count in the training documents, and their least count; the rest go by shape.
VOCABULARY, LEAST_COUNT = 16_000, 3
#: Shards of the counts, by the middle word of a trigram: so many at least, and one for each so many training words.
SHARDS, SHARD_WORDS = 8, 16_000_000
#: Training words whose counts are copied in all, so that tasks of one shard can be many.
COPIED_WORDS = 16_000_000
#: Trigrams that are counted at once, and that travel in one row.
HELD = 1_000_000
#: The threshold of a language: this quantile of its trusted documents, and so much of its distance from their median beyond it.
QUANTILE, SLACK = 0.99, 1.0
#: Languages whose thresholds are broadcast; where there are more, documents are joined by language.
BROADCAST_LANGUAGES = 10_000
#: Ids of training documents and keys of rejected rows are broadcast up to this number, and joined beyond it.
BROADCAST_KEYS = 2_000_000
#: Tokens at the language's median that are added to a document, so that a few odd words don't reject a short text.
PRIOR = 20.0
TOKENS = re.compile(r"\w+|[^\w\s]+")
SHAPES = ["<s>", "</s>", "<num>", "<sym>", "<low>", "<up>", "<cap>", "<mix>"]


class Model(NamedTuple):
    """What every shard needs of the model: bounded by VOCABULARY."""

    vocabulary: dict[str, int]
    unigram: np.ndarray  # probability of each word number
    discounts: tuple[tuple[float, ...], tuple[float, ...]]  # of trigrams, bigrams; by count 1, 2, 3 or more
    shards: int
    words: int  # of the vocabulary in the training texts


def shape(word: str) -> str:
    first = word[0]
    if first.isdigit():
        return "<num>"
    if not first.isalpha():
        return "<sym>"
    if word.islower():
        return "<low>"
    if word.isupper():
        return "<up>"
    return "<cap>" if first.isupper() and word[1:].islower() else "<mix>"


def numbered(text: str, vocabulary: dict[str, int]) -> list[int]:
    """Word numbers of a text, one end mark last."""
    get = vocabulary.get
    return [i if (i := get(w)) is not None else get(shape(w)) for w in TOKENS.findall(text)] + [1]


def trigram_keys(texts: list[str], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys u<<32 | v<<16 | w of all tokens of texts, two start marks before each text, and their number in each text."""
    parts, sizes = [], []
    for t in texts:
        x = np.array([0, 0, *numbered(t, vocabulary)], dtype=np.int64)
        parts.append(x[:-2] << 32 | x[1:-1] << 16 | x[2:])
        sizes.append(len(x) - 2)
    return np.concatenate(parts) if parts else np.empty(0, np.int64), np.array(sizes, dtype=np.int64)


def discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen 1 to 4 times."""
    n1, n2, n3, n4 = (max(1, counts.get(i, 0)) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return tuple(min(float(i), max(0.0, d)) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


class Counts:
    """One order of a shard: n-grams with counts, and of each context its total and the mass its discounts free."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, contexts: np.ndarray, discount: tuple[float, ...]):
        self.grams = grams
        self.held = counts - np.array(discount)[np.minimum(counts, 3) - 1]
        self.contexts, at = np.unique(contexts, return_inverse=True)
        self.total = np.bincount(at, counts)
        self.free = np.bincount(at, np.array(discount)[np.minimum(counts, 3) - 1])

    def mix(self, grams: np.ndarray, contexts: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Interpolated probabilities; the lower order's where the context is unknown."""
        if not len(self.grams):
            return lower
        g = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        c = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        seen = np.where(self.grams[g] == grams, self.held[g], 0.0)
        return np.where(self.contexts[c] == contexts, (seen + self.free[c] * lower) / self.total[c], lower)


class Shard:
    """Both orders of the trigrams of some middle words; the bigram order counts the words before."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, model: Model):
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        self.trigrams = Counts(keys, counts, keys >> 16, model.discounts[0])
        pairs, before = np.unique(keys & 0xFFFFFFFF, return_counts=True)
        self.bigrams = Counts(pairs, before, pairs >> 16, model.discounts[1])
        self.unigram = model.unigram

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        pairs = keys & 0xFFFFFFFF
        two = self.bigrams.mix(pairs, pairs >> 16, self.unigram[keys & 0xFFFF])
        return np.log(self.trigrams.mix(keys, keys >> 16, two))


def row_key(id_col: str, text_col: str) -> Column:
    """A document's row in joins; rows of equal id and text share it, and score alike."""
    return F.xxhash64(F.col(id_col).cast("long"), whole_text(text_col))


def split_trusted(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of the trusted documents to train on, about half of them by a hash, and of the others, which set thresholds."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    mark = F.xxhash64("doc_id")
    return good.where(F.pmod(mark, F.lit(2)) == 0), good.where(F.pmod(mark, F.lit(2)) == 1)


def _squeezed(*columns: np.ndarray) -> list[bytes]:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    return [squeeze(c.tobytes()) for c in columns]


def _grams(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Different keys with counts, squeezed as differences in the order of middle, first and last word."""
    turned = (keys >> 16 & 0xFFFF) << 32 | keys >> 32 << 16 | keys & 0xFFFF
    order = np.argsort(turned)
    return tuple(_squeezed(np.diff(turned[order], prepend=0).astype("<i8"), counts[order].astype("<i8")))


def _counted(row: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of what _grams() gave."""
    deltas, counts = (np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<i8") for x in row)
    turned = np.cumsum(deltas)
    return (turned >> 16 & 0xFFFF) << 32 | turned >> 32 << 16 | turned & 0xFFFF, counts


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64)


GRAMS = "shard int, kind int, keys binary, counts binary"


def _gram_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["shard", "kind", "keys", "counts"])


def train(texts: DataFrame) -> tuple[Model, DataFrame] | None:
    """The model of texts (text) and its trigram counts (GRAMS; kind 0), or None without texts.

    Counts are squeezed by shard before they move, and merged there. The counts of lower orders come from the same
    reading: a shard has all trigrams of its middle words, so all words before its bigrams.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w for t in batch.column(0).to_pylist() for w in TOKENS.findall(t)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["word"])

    frequent = texts.mapInArrow(words, "word string").groupBy("word").count().where(F.col("count") >= LEAST_COUNT)
    chosen = frequent.orderBy(F.desc("count"), "word").limit(VOCABULARY).collect()
    n, parts = sum(r["count"] for r in chosen), partitions(texts.sparkSession)
    shards = max(SHARDS, n // SHARD_WORDS)
    vocabulary = {w: i for i, w in enumerate([*SHAPES, *(r.word for r in chosen)])}

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            shard = (found >> 16 & 0xFFFF) % shards
            return _gram_rows([(int(k), 0, *_grams(found[at], counts[at])) for k in np.unique(shard) for at in [shard == k]])

        for batch in batches:
            held.append(trigram_keys(batch.column(0).to_pylist(), vocabulary)[0])
            if sum(map(len, held)) >= HELD:
                yield out()
        if sum(map(len, held)):
            yield out()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of each shard, whose rows follow each other, as kind 0; what the lower orders need of them as kind 1 (order << 32 | count or word)."""
        at, rows, size = None, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            found, counts = _summed(*(np.concatenate(c) for c in zip(*rows)))
            pairs, before = np.unique(found & 0xFFFFFFFF, return_counts=True)
            last, ways = np.unique(pairs & 0xFFFF, return_counts=True)
            few = [(order << 32 | c, int((x == c).sum())) for order, x in ((3, counts), (2, before)) for c in (1, 2, 3, 4)]
            what, n = np.array([k for k, _ in few] + (1 << 32 | last).tolist()), np.array([m for _, m in few] + ways.tolist())
            yield _gram_rows([(at, 1, *_squeezed(what.astype("<i8"), n.astype("<i8")))])
            for k in range(0, len(found), HELD):
                yield _gram_rows([(at, 0, *_grams(found[k : k + HELD], counts[k : k + HELD]))])

        for batch in batches:
            for shard, _, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and shard != at:
                    yield from out()
                    rows, size = [], 0
                at = shard
                rows.append(_counted(row))
                size += len(rows[-1][0])
                if size >= 4 * HELD:
                    rows = [_summed(*(np.concatenate(c) for c in zip(*rows)))]
                    size = 0
        if rows:
            yield from out()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                what, n = (np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<i8") for x in row)
                yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(n)], ["what", "n"])

    three = cut(texts.mapInArrow(keys, GRAMS).repartition(min(shards, parts), "shard").sortWithinPartitions("shard").mapInArrow(merged, GRAMS))
    # bounded by the vocabulary
    sums = {r.what: r.n for r in three.where("kind = 1").mapInArrow(listed, "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).collect()}
    one = {k & 0xFFFF: n for k, n in sums.items() if k >> 32 == 1}
    if not one:
        return None
    of = lambda order: discounts({c: sums.get(order << 32 | c, 0) for c in (1, 2, 3, 4)})
    counts = np.zeros(len(vocabulary))
    for w, ways in one.items():
        counts[w] = ways
    d = discounts({c: sum(1 for x in one.values() if x == c) for c in (1, 2, 3, 4)})
    taken = np.where(counts > 0, np.array(d)[np.minimum(np.maximum(counts, 1), 3).astype(int) - 1], 0.0)
    unigram = (counts - taken + taken.sum() / len(vocabulary)) / counts.sum()
    return Model(vocabulary, unigram, (of(3), of(2)), shards, n), three.where("kind = 0")


def perplexities(docs: DataFrame, model: Model, three: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, log_p, n): natural log probability and tokens of every document row.

    Tokens travel as packed trigram keys, a row for each batch of documents and shard; counts travel to every
    partition that has their shard; both are sorted, counts first, and joined in one pass over each partition.
    The number of shards grows with the training words, and copies of a shard get fewer, so a task holds a shard of
    bounded size (the trigrams of one middle word at the least) and the copies don't outgrow the counts.
    """
    shards = model.shards
    salts = max(1, min(-(-partitions(docs.sparkSession) // 4), COPIED_WORDS // max(1, model.words)))
    schema = "shard int, salt int, kind int, ids binary, sizes binary, keys binary"

    def packed(ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> list[bytes]:
        # a document's tokens may come in any order: that of their middle words squeezes best, as differences
        turned = np.sort(np.repeat(np.arange(len(sizes)), sizes) << 48 | (keys >> 16 & 0xFFFF) << 32 | keys >> 32 << 16 | keys & 0xFFFF)
        columns = np.stack([np.diff(turned >> 32 & 0xFFFF, prepend=0), turned >> 16, turned]).astype("<u2")
        return _squeezed(ids.astype("<i8"), sizes.astype("<i4"), columns)

    def unpacked(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        open_ = zstandard.ZstdDecompressor().decompress
        v, u, w = np.frombuffer(open_(row[2]), "<u2").reshape(3, -1).astype(np.int64)
        v = np.cumsum(v) & 0xFFFF
        return np.frombuffer(open_(row[0]), "<i8"), np.frombuffer(open_(row[1]), "<i4"), u << 32 | v << 16 | w

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), types)], ["shard", "salt", "kind", "ids", "sizes", "keys"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.array(batch.column(0))
            keys, sizes = trigram_keys(batch.column(1).to_pylist(), model.vocabulary)
            owner, shard = np.repeat(np.arange(len(ids)), sizes), (keys >> 16 & 0xFFFF) % shards
            rows = []
            for s in np.unique(shard):
                at = shard == s
                n = np.bincount(owner[at], minlength=len(ids))
                rows.append((int(s), int(ids[0] % salts), 1, *packed(ids[n > 0], n[n > 0], keys[at])))
            yield batch_of(rows)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, parts = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != at:
                    at, shard, parts = row[:2], None, []
                if not row[2]:
                    parts.append(_counted((row[5], row[4])))
                    continue
                ids, sizes, keys = unpacked(row[3:])
                if shard is None:
                    parts = parts or [(np.empty(0, np.int64), np.empty(0, np.int64))]
                    shard, parts = Shard(*(np.concatenate(c) for c in zip(*parts)), model), []
                sums = np.add.reduceat(shard.log_probabilities(keys), np.r_[0, np.cumsum(sizes)[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums), pa.array(sizes.astype(np.int64))], ["k", "log_p", "n"])

    asked = docs.select(row_key(id_col, text_col).alias("k"), whole_text(text_col).alias("text")).mapInArrow(ask, schema)
    held = three.select("shard", F.lit(0).alias("kind"), F.lit(b"").alias("ids"), F.col("counts").alias("sizes"), "keys")
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("shard", "salt", "kind", "ids", "sizes", "keys")
    arrow_rows(docs.sparkSession, 256)
    met = asked.union(held).repartition(partitions(docs.sparkSession), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return met.mapInArrow(answer, "k long, log_p double, n long").groupBy("k").agg(F.sum("log_p").alias("log_p"), F.sum("n").alias("n"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(k, doc_id, lang, n_tokens, log_perplexity, threshold, accepted) of every document.

    labels (doc_id, quality): documents of quality 1 are trusted. About half of them, by a hash, train an
    interpolated modified Kneser-Ney trigram model on a closed vocabulary, in which other words go by their
    shape. log_perplexity is the mean negative natural log probability of a document's tokens and its end. A
    language's threshold is the quantile of the other half's, plus slack times its distance from their median;
    languages without such documents take that of all languages. A document is accepted where its mean, with
    prior tokens at the median added, is not above the threshold.

    Null text is empty (its end alone is scored); null languages form one of their own; null ids and repeated
    rows are kept. Without trusted documents nothing is scored and all are accepted. An empty table gives an
    empty result; other columns are ignored. k is the row's key.
    """
    learn, judge = split_trusted(labels)
    base = docs.select(row_key(id_col, text_col).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"))
    arrow_rows(docs.sparkSession, 256)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    learn = cut(learn)
    trained = train(texts.join(F.broadcast(learn) if learn.count() <= BROADCAST_KEYS else learn, "doc_id", "left_semi").select("text"))
    if trained is None:
        none = F.lit(None).cast("double")
        return base.select("k", "doc_id", "lang", F.lit(None).cast("long").alias("n_tokens"), none.alias("log_perplexity"), none.alias("threshold"), F.lit(True).alias("accepted"))
    scores = cut(perplexities(docs, *trained, id_col, text_col).select("k", "n", (-F.col("log_p") / F.col("n")).alias("mean")))
    known = cut(base.join(scores, "k"))
    # rounded, so that the exact quantile keeps a bounded table of values
    marks = [F.percentile(F.round("mean", 3), F.lit(q)) for q in (quantile, 0.5)]
    edges = [(marks[0] + slack * (marks[0] - marks[1])).alias("threshold"), marks[1].alias("median")]
    judged = cut(known.join(judge, "doc_id").select("lang", "mean"))
    whole = judged.agg(*edges).first()
    fallback = (whole.threshold, whole.median) if whole.threshold is not None else (math.inf, 0.0)
    by_lang = cut(judged.groupBy("lang").agg(*edges))
    by_lang = F.broadcast(by_lang) if by_lang.count() <= BROADCAST_LANGUAGES else by_lang
    joined = known.join(by_lang, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(fallback[0]))).withColumn("median", F.coalesce("median", F.lit(fallback[1])))
    held = (F.col("mean") * F.col("n") + F.col("median") * prior) / (F.col("n") + prior)
    return joined.select("k", "doc_id", "lang", F.col("n").alias("n_tokens"), F.round("mean", 6).alias("log_perplexity"), F.round("threshold", 6).alias("threshold"), (held <= F.col("threshold")).alias("accepted"))


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that classify() accepts, columns as they were."""
    verdicts = classify(docs, labels, **options)
    (rejected_key,) = free(docs, "rejected_key")
    rejected = cut(verdicts.where("not accepted").select(F.col("k").alias(rejected_key)).distinct())
    few = rejected.count() <= BROADCAST_KEYS
    key = row_key(options.get("id_col", "doc_id"), options.get("text_col", "text"))
    return docs.join(F.broadcast(rejected) if few else rejected, key == F.col(rejected_key), "left_anti")
