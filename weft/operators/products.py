"""Pairs of sparse unit vectors with a large dot product, compared block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.lineage import cut

#: Entries and vectors of one block; two blocks meet in a task.
BLOCK_ENTRIES, BLOCK_VECTORS = 1_500_000, 16_384
#: Buckets of a sketch, at least and at the most.
DENSE, WIDEST = 64, 2048
#: Cells of a task's matrix and products that it holds at once, and entries that it gathers at once.
HELD, GATHERED = 2_000_000, 131_072
#: Times, measured: a bucket of a pair's product, and a pair that is multiplied whole and an entry of it.
CELL_NS, PAIR_NS, ENTRY_NS = 0.033, 5_000, 12
#: What a bound in single precision may lack, at the most.
SLACK = 5e-4
PAIRS = "a bigint, b bigint, similarity double"


class Vectors:
    """Vectors of a block, whose entries lie by vector: different terms in order, and for each entry its term's place and its weight."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray, places: np.ndarray | None = None):
        """terms: of each entry, or the different ones in order where places are given."""
        self.ids, self.offsets, self.weights = ids, offsets.astype(np.int64), weights
        if places is None:
            terms, places = np.unique(terms, return_inverse=True)
        self.terms, self.places = terms, places.astype(np.int32, copy=False)
        self.sizes = np.diff(self.offsets)
        self.mean = len(weights) / max(1, len(ids))

    def sketch(self, buckets: int) -> np.ndarray:
        """For each vector the lengths of its parts in each bucket of the frequent terms. Two vectors' dot product over those terms is
        that of their sketches at the most (Cauchy and Schwarz in each bucket)."""
        bucket = np.where(self.terms < 0, (-1 - self.terms) % buckets, buckets).astype(np.int64)
        out = np.empty((len(self.ids), buckets), np.float32)
        step = max(1, HELD // 4 // (buckets + 1))
        for k in range(0, len(self.ids), step):
            n = min(step, len(self.ids) - k)
            a, z = self.offsets[k], self.offsets[k + n]
            cell = np.repeat(np.arange(n) * (buckets + 1), self.sizes[k : k + n]) + bucket[self.places[a:z]]
            sums = np.bincount(cell, self.weights[a:z] ** 2, n * (buckets + 1)).reshape(n, buckets + 1)
            out[k : k + n] = np.sqrt(sums[:, :buckets])
        return out

    def some(self, most: int) -> Vectors:
        """Up to so many of the vectors, of all lengths."""
        rows = np.unique(np.linspace(0, len(self.ids) - 1, min(most, len(self.ids))).astype(np.int64))
        ends = np.cumsum(self.sizes[rows])
        at = np.arange(ends[-1]) + np.repeat(self.offsets[rows] - (ends - self.sizes[rows]), self.sizes[rows])
        return Vectors(self.ids[rows], np.concatenate([[0], ends]), self.terms, self.weights[at], self.places[at])

    def rare(self) -> tuple[np.ndarray, np.ndarray]:
        """The entries whose terms are not frequent, and the vector of each."""
        at = np.flatnonzero((self.terms >= 0)[self.places]).astype(np.int32)
        return at, np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)[at]


class Inverted:
    """The vectors of each rare term of a block."""

    def __init__(self, vectors: Vectors):
        at, of = vectors.rare()
        order = np.argsort(vectors.places[at], kind="stable")
        self.of, self.weights = of[order], vectors.weights[at[order]].astype(np.float32)
        self.counts = np.bincount(vectors.places[at], minlength=len(vectors.terms))
        self.starts = np.cumsum(self.counts) - self.counts


class Segments:
    """The entries of a block in rows of equal length, filled up with a place behind all terms."""

    def __init__(self, vectors: Vectors):
        width = int(min(64, max(4, vectors.mean // 4)))
        self.counts = -(-vectors.sizes // width)
        self.starts = np.cumsum(self.counts) - self.counts
        rows = int(self.counts.sum())
        at = np.repeat((self.starts * width - vectors.offsets[:-1]).astype(np.int32), vectors.sizes) + np.arange(len(vectors.weights), dtype=np.int32)
        self.places, self.weights = np.full(rows * width, len(vectors.terms), np.int32), np.zeros(rows * width)
        self.places[at], self.weights[at] = vectors.places, vectors.weights
        self.places, self.weights, self.width = self.places.reshape(rows, width), self.weights.reshape(rows, width), width


class Dots:
    """Dot products of named pairs: a vector of left is laid out over right's terms, where those of right are looked up."""

    def __init__(self, left: Vectors, right: Vectors, place: np.ndarray):
        self.left, self.place, self.segments = left, place, Segments(right)
        self.laid = np.zeros(len(right.terms) + 2)  # behind the terms a place that stays 0, and one for terms that right has not

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """x in order."""
        s, out = self.segments, np.empty(len(x))
        rows, first = np.unique(x, return_index=True)
        for row, a, z in zip(rows.tolist(), first.tolist(), [*first[1:].tolist(), len(x)]):
            entries = slice(self.left.offsets[row], self.left.offsets[row + 1])
            places = self.place[self.left.places[entries]]
            self.laid[places] = self.left.weights[entries]
            counts = s.counts[y[a:z]]
            ends = np.cumsum(counts)
            while a < z:
                done = ends[-1] - ends[len(ends) - (z - a)] + counts[len(ends) - (z - a)]  # segments from a on
                k = z - a if done * s.width <= GATHERED else max(1, int(np.searchsorted(ends[len(ends) - (z - a) :] - (ends[-1] - done), GATHERED // s.width, "right")))
                n, some = s.counts[y[a : a + k]], s.starts[y[a : a + k]]
                begin = np.cumsum(n) - n
                which = np.arange(int(n.sum())) + np.repeat(some - begin, n)
                sums = np.einsum("ij,ij->i", self.laid.take(s.places[which]), s.weights[which])
                out[a : a + k] = np.add.reduceat(sums, begin)
                a += k
            self.laid[places] = 0
        return out


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (least node of each) after the links a, b."""
    while len(a):
        x, y = labels[a], labels[b]
        if not (apart := x != y).any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        labels = labels.copy()
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while ((up := labels[labels]) != labels).any():
            labels = up
    return labels


def _buckets(left: Vectors, right: Vectors, least: float) -> int:
    """How wide sketches should be: about the least time for their product and for the pairs that they let pass in vain, as some vectors show it."""
    one, other = left.some(256).sketch(WIDEST), right.some(1024).sketch(WIDEST)
    buckets, cost, passed = WIDEST, {}, []
    while buckets >= DENSE:
        passed.append((one @ other.T >= least - SLACK).mean())
        cost[buckets] = buckets * CELL_NS + (passed[-1] - passed[0]) * (PAIR_NS + ENTRY_NS * min(left.mean, right.mean))
        buckets //= 2
        one, other = (np.sqrt(x[:, :buckets] ** 2 + x[:, buckets:] ** 2) for x in (one, other))
    return min(cost, key=cost.get)


def close_pairs(left: Vectors, right: Vectors, least: float, forest: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in left, places in right, dot products) of the pairs whose product is least or more; of a block with itself each pair once.

    A product of matrices bounds the frequent terms' part by sketches, the other terms' part is multiplied through an inverted index of
    right; pairs whose sum could reach least are multiplied whole: an exact bound. With forest pairs that are joined already are left out, likelier pairs coming first.
    """
    if left.mean < right.mean:  # the shorter ones are looked up
        for x, y, dots in close_pairs(right, left, least, forest):
            yield y, x, dots
        return
    own, n = left is right, len(right.ids)
    if not len(left.ids) or not n:
        return
    at_right = np.searchsorted(right.terms, left.terms)
    held = right.terms[np.minimum(at_right, len(right.terms) - 1)] == left.terms if len(right.terms) else np.zeros(len(left.terms), bool)
    dots = Dots(left, right, np.where(held, at_right, len(right.terms) + 1))
    buckets = _buckets(left, right, least)
    one = left.sketch(buckets)
    other = one if own else right.sketch(buckets)
    index = Inverted(right)
    entry, of = left.rare()
    there = held[left.places[entry]]
    entry, of = entry[there], of[there]
    place = at_right.astype(np.int32)[left.places[entry]]
    there = index.counts[place] > 0
    entry, of, place = entry[there], of[there], place[there]
    sums = np.concatenate([[0], np.cumsum(index.counts[place])])
    labels = np.arange(len(left.ids) + (0 if own else n))
    shift = 0 if own else len(left.ids)
    step = max(1, HELD // n)
    for at in range(0, len(left.ids), step):
        to = min(at + step, len(left.ids))
        begin = at if own else 0
        width = n - begin
        cells = (one[at:to] @ other[begin:].T).reshape(-1)
        a, z = np.searchsorted(of, [at, to]).tolist()
        while a < z:
            b = max(a + 1, min(z, int(np.searchsorted(sums, sums[a] + HELD // 4, "right")) - 1))
            p = place[a:b]
            counts = index.counts[p]
            which = np.arange(int(counts.sum())) + np.repeat(index.starts[p] - (np.cumsum(counts) - counts), counts)
            column, product = index.of[which] - begin, np.repeat(left.weights[entry[a:b]].astype(np.float32), counts) * index.weights[which]
            cell = np.repeat((of[a:b] - at).astype(np.int64) * width, counts) + column
            cell, product = (cell[column >= 0], product[column >= 0]) if begin else (cell, product)
            np.add.at(cells, cell, product)
            a = b
        found = np.flatnonzero(cells >= least - SLACK)
        x, y = found // width + at, found % width + begin
        if own:
            found, x, y = found[x < y], x[x < y], y[x < y]
        if not forest:
            d = dots.of(x, y)
            keep = d >= least - 1e-12
            if keep.any():
                yield x[keep], y[keep], d[keep]
            continue
        sure, limit, rows = cells[found], 1, True  # the first time the likeliest pair of each row, then some of every two components
        while len(x):
            one_label, other_label = labels[x], labels[y + shift]
            apart = one_label != other_label
            x, y, sure, one_label, other_label = (c[apart] for c in (x, y, sure, one_label, other_label))
            group = x if rows else np.minimum(one_label, other_label) * len(labels) + np.maximum(one_label, other_label)
            order = np.lexsort((-sure, group))
            rank = np.arange(len(x)) - np.searchsorted(group[order], group[order])
            now = np.zeros(len(x), bool)
            now[order[rank < limit]] = True
            i, j = x[now], y[now]
            d = dots.of(i, j)
            keep = d >= least - 1e-12
            if keep.any():
                labels = _joined(labels, i[keep], j[keep] + shift)
                yield i[keep], j[keep], d[keep]
            x, y, sure = x[~now], y[~now], sure[~now]
            limit, rows = limit if rows else 4 * limit, False


class Forest:
    """Union-find over ids."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[y]
        return x

    def joins(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


KEPT = ("ids", "offsets", "terms", "places", "weights")


def packed(block: int, ids: np.ndarray, of: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    """A block's row (block, packed): its vectors, shortest first, from entries of (place in ids, term, weight) by vector."""
    sizes = np.bincount(of, minlength=len(ids))
    rank = np.argsort(sizes, kind="stable")
    order = np.argsort(np.argsort(rank)[of], kind="stable")
    terms, places = np.unique(terms, return_inverse=True)
    columns = (ids[rank], np.concatenate([[0], np.cumsum(sizes[rank])]), terms, places[order].astype(np.int32), weights[order])
    part = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in columns], KEPT)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(part)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "packed"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of a task, which are one block, as one row (block, packed)."""
    held = [b for b in batches if b.num_rows]
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        terms, weights = rows["terms"].chunk(0), rows["weights"].chunk(0)
        of = np.repeat(np.arange(rows.num_rows), np.diff(terms.offsets.to_numpy()))
        yield packed(rows["block"][0].as_py(), rows["id"].to_numpy(), of, terms.flatten().to_numpy(), weights.flatten().to_numpy())


def _unpacked(block: pa.Scalar) -> Vectors:
    part = pa.ipc.open_stream(block.as_buffer()).read_next_batch()
    ids, offsets, terms, places, weights = (part.column(c).flatten().to_numpy() for c in KEPT)
    return Vectors(ids, offsets, terms, weights, places)


def _met(left: Vectors, right: Vectors, least: float, forest: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of two blocks, or of a block with itself."""
    tree = Forest()
    for x, y, s in close_pairs(left, right, least, forest):
        i, j = left.ids[x], right.ids[y]
        a, b = np.minimum(i, j), np.maximum(i, j)
        if forest:
            new = np.array([tree.joins(p, q) for p, q in zip(a.tolist(), b.tolist())], bool)
            a, b, s = a[new], b[new], s[new]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "similarity"])


def spread(df: DataFrame, n: int) -> int:
    """So many blocks of n vectors give work to all tasks."""
    return max(1, min(int((2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) ** 0.5) + 1, n // 256))


def bands(sizes: list[tuple[int, int, int]], least: int) -> dict[int, tuple[int, int]]:
    """Of each class of lengths its first block and how many blocks it is dealt to, at least about so many in all.

    sizes: each class, shortest first, with its vectors and entries. Blocks hold vectors of about one length; small classes share some.
    """
    most = min(BLOCK_ENTRIES, max(1, sum(e for *_, e in sizes) // least))
    out, group, vectors, entries, first = {}, [], 0, 0, 0
    for k, (one, n, e) in enumerate(sizes, 1):
        group, vectors, entries = [*group, one], vectors + n, entries + e
        if entries >= most or vectors >= BLOCK_VECTORS or k == len(sizes):
            count = max(1, -(-entries * 9 // (most * 10)), -(-vectors // BLOCK_VECTORS))  # up to a ninth more than most
            out |= dict.fromkeys(group, (first, count))
            group, vectors, entries, first = [], 0, 0, first + count
    return out


def pairs(vectors: DataFrame, least: float, forest: bool = False, size: tuple[int, int] | None = None) -> DataFrame:
    """(a, b, similarity), a < b, of vectors (id long, terms array<bigint>, weights array<double>) of unit length with a dot product of at least least.

    Terms below zero are the frequent ones, whose part of a product is bounded before it is taken; which ones are changes only the time.
    Vectors are dealt to blocks of bounded size by a hash of their id. Null ids take no part. size has the number of vectors and of
    their entries where they are known, else the vectors are stored once more to be counted. See meet().
    """
    held = vectors.where("id is not null")
    held = held if size else cut(held)
    n, entries = size or held.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-entries // BLOCK_ENTRIES), -(-n // BLOCK_VECTORS), spread(held, n))
    dealt = held.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.col("id").cast("bigint").alias("id"), "terms", "weights")
    return meet(cut(dealt.repartitionById(blocks, "block").mapInArrow(_packed, "block int, packed binary")), least, forest)


def meet(stored: DataFrame, least: float, forest: bool = False) -> DataFrame:
    """pairs() of a checkpoint of blocks (block, packed), one in a partition.

    Each is one row of a checkpoint, and every two meet once, in one task, which reads them there, so that no vector is copied to disk for
    each block it meets. With forest each task returns a spanning forest of the links it finds, so that a group of n alike vectors
    makes links in the order of n, not n * n. The work grows with the square of the vectors: a bound for every pair, by a product of matrices.
    Moved and stored rows grow with the vectors, reads of the checkpoint with vectors times blocks.
    """
    left, right = (stored.select(F.col("block").alias(f"{x}_block"), F.col("packed").alias(x)) for x in ("left", "right"))
    # a Cartesian product has a task for every two partitions and shuffles nothing
    cells = left.join(right.hint("shuffle_replicate_nl"), F.col("left_block") <= F.col("right_block"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*batch.columns))
            del batch
            while rows:
                a, left, b, right = rows.pop()
                one = _unpacked(left)
                other = one if a.as_py() == b.as_py() else _unpacked(right)
                del left, right  # their bytes are not held while the vectors are compared
                yield from _met(one, other, least, forest)
                del one, other
                pa.default_memory_pool().release_unused()

    return cells.select("left_block", "left", "right_block", "right").mapInArrow(met, PAIRS)
