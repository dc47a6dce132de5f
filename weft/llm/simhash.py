"""SimHash fingerprints and near-duplicate components by tiled exact comparison."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import arrow_rows, cut, free, partitions, whole_text
from weft.operators.graph import components

#: Fingerprints of one block; a tile with more is cut into several blocks.
BLOCK = 4096
#: Blocks of one tile that meet in one task.
MEET = 8
#: Shingles of one block, about, where links are verified; near texts of a node that are judged one by one, beyond it all at once.
BLOCK_SHINGLES, FEW = 2_000_000, 8
#: Segments of a fingerprint whose population counts name its tile, and beyond CROWDED fingerprints.
SEGMENTS, FINE_SEGMENTS, CROWDED = 4, 8, 1 << 24
#: Counts of up to so many tiles are broadcast: 17 ** SEGMENTS, or a hundred sizes, never are more.
BROADCAST_TILES = 100_000
#: Up to so many texts that block pairs ask for are named in a broadcast list, beyond it by a join.
ASKED = 500_000
SEED = 42


def shingle_hashes(text: str, width: int, seed: int = SEED) -> list[int]:
    """XXH64 of every shingle of width words, repeats included; the whole sequence where there are fewer words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[width - 1 :])]


def fingerprint(hashes: list[int] | np.ndarray, words: int = 1) -> bytes:
    """words x 64 bits, big-endian: a bit is set where it is set in over half the hashes; zero for no hashes.

    Bits after the first 64 come from the hashes multiplied by odd numbers, high half folded in.
    """
    if not len(hashes):
        return bytes(8 * words)
    h = np.array(hashes, dtype=np.uint64)
    out = []
    for k in range(words):
        x = h if not k else _mixed(h, k)
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(x), 1 << 16):
            ones += np.unpackbits(x[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(x)).tobytes())
    return b"".join(out)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(33))) * np.uint64(2 * k * 0x9E3779B97F4A7C15 + 1 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _set(text: str, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(np.array(shingle_hashes(text, width), dtype=np.uint64))


def _name(hashes: np.ndarray) -> bytes:
    """16 bytes that tell sets of shingles apart."""
    return xxhash.xxh3_128_digest(hashes.astype(">u8").tobytes(), SEED)


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """(doc_id, mark, fp binary, n_shingles) of every document; null text counts as empty; mark is the hash of the text.

    With distinct, repeated shingles count once, and fp ends in 16 bytes more that name the set of shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes = [], []
            for text in batch.column(2):
                hashes = _set(text.as_py(), width) if distinct else shingle_hashes(text.as_py(), width)
                fps.append(fingerprint(hashes, words) + (_name(hashes) if distinct else b""))
                sizes.append(len(hashes))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "mark", "fp", "n_shingles"])

    arrow_rows(docs.sparkSession, 512)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), mark(text_col).alias("mark"), whole_text(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, mark long, fp binary, n_shingles long")


def mark(text_col: str) -> Column:
    """With its doc_id, what tells a row from others; rows of equal id and text are repeated rows."""
    return F.xxhash64(whole_text(text_col))


def _half_ball(dims: int, radius: int) -> list[list[int]]:
    """Integer offsets of L1 length radius at most, one of each pair of opposites, zero first."""
    ball = [p for p in itertools.product(range(-radius, radius + 1), repeat=dims) if sum(map(abs, p)) <= radius]
    zero = (0,) * dims
    return [list(zero), *[list(p) for p in ball if p > zero]]


def _popcounts(segments: int) -> F.Column:
    """Population count of each of segments equal parts of the first 64 bits."""
    step = 64 // segments
    number = F.conv(F.substring(F.hex("fp"), 1, 16), 16, -10).cast("long")
    mask = -1 if step == 64 else (1 << step) - 1
    return F.array(*[F.bit_count(F.shiftrightunsigned(number, step * i).bitwiseAND(F.lit(mask).cast("long"))).cast("int") for i in range(segments)])


def _near(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bits) of the pairs of at most radius differing bits, strip by strip of a.

    a, b: (n, words) uint64. same: b is a, and j is above i. Some word of a pair differs by radius / words bits or fewer,
    so only pairs with such a word are summed up.
    """
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        near = np.bitwise_count(part[:, :1] ^ b[None, :, 0]) <= radius // a.shape[1]
        for k in range(1, a.shape[1]):
            near |= np.bitwise_count(part[:, k : k + 1] ^ b[None, :, k]) <= radius // a.shape[1]
        if same:
            near &= np.arange(len(b))[None, :] > np.arange(at, at + len(part))[:, None]
        i, j = np.nonzero(near)
        if not len(i):
            continue
        i += at
        bits = np.bitwise_count(a[i] ^ b[j]).sum(axis=1, dtype=np.int64)
        ok = bits <= radius
        yield i[ok], j[ok], bits[ok]


def _forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what links of at most radius bits join, shortest first: at most one less than the nodes."""
    base = 0 if same else len(a)
    start = np.arange(len(a) + (0 if same else len(b)))
    root = start.copy()
    limit = 4 * len(root)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    left, right = [], []

    def union(i: np.ndarray, j: np.ndarray) -> None:
        """Hook roots on smaller roots until the links i-j lie within trees; keeps the links used."""
        while len(i):
            ri, rj = root[i], root[j]
            open_ = ri != rj
            i, j, ri, rj = i[open_], j[open_], ri[open_], rj[open_]
            if not len(i):
                return
            high, low = np.maximum(ri, rj), np.minimum(ri, rj)
            order = np.lexsort((low, high))
            keep = order[np.r_[True, high[order][1:] != high[order][:-1]]]
            left.append(i[keep])
            right.append(j[keep])
            root[high[keep]] = low[keep]
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up

    for i, j, bits in _near(a, b, same, radius):
        j = j + base
        if len(i) > limit:  # a dense strip: its own short links stand for it
            for level in np.unique(bits):
                union(i[bits == level], j[bits == level])
            i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
            left.clear(), right.clear()
            root[:] = start
            bits = np.bitwise_count(a[i] ^ (b[j - base] if not same else a[j])).sum(axis=1, dtype=np.int64)
        found.append((i, j, bits))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j, bits = (np.concatenate(x) for x in zip(*found))
    for level in np.unique(bits):
        union(i[bits == level], j[bits == level])
    return (np.concatenate(left), np.concatenate(right)) if left else (i[:0], j[:0])


def _matrix(fps: list[bytes], words: int) -> np.ndarray:
    return np.frombuffer(b"".join(x[: 8 * words] for x in fps), ">u8").astype(np.uint64).reshape(-1, words)


def _compare(words: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for xs, ys, same in zip(*(batch.column(k) for k in ("a_fps", "b_fps", "same"))):
                xs, same = [v.as_py() for v in xs.values], same.as_py()
                ys = xs if same else [v.as_py() for v in ys.values]
                a = _matrix(xs, words)
                i, j = _forest(a, a if same else _matrix(ys, words), same, radius)
                if len(i):
                    pool = xs if same else xs + ys
                    yield pa.RecordBatch.from_arrays([pa.array([pool[k] for k in x], pa.binary()) for x in (i, j)], ["a", "b"])

    return run


def _asked(words: int, radius: int):
    """Of each block pair (a_fps, b_fps, same, pair) the fingerprints that are near another, and on which side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for xs, ys, same, pair in zip(*(batch.column(k) for k in ("a_fps", "b_fps", "same", "pair"))):
                xs, same = [v.as_py() for v in xs.values], same.as_py()
                ys = xs if same else [v.as_py() for v in ys.values]
                a = _matrix(xs, words)
                b = a if same else _matrix(ys, words)
                left, right = np.zeros(len(a), bool), np.zeros(len(b), bool)
                for i, j, _ in _near(a, b, same, radius):
                    left[i] = True
                    right[j] = True
                for of_a, fps, at in ((True, xs, left | right),) if same else ((True, xs, left), (False, ys, right)):
                    if at.any():
                        fps = [fps[k] for k in np.flatnonzero(at)]
                        yield pa.RecordBatch.from_arrays([pa.array([pair.as_py()] * len(fps), pa.int64()), pa.array([same] * len(fps)), pa.array([of_a] * len(fps)), pa.array(fps, pa.binary())], ["pair", "same", "of_a", "fp"])

    return run


def _similar(a: np.ndarray, b: np.ndarray, x: list[np.ndarray], y: list[np.ndarray], same: bool, radius: int, least: float) -> list[tuple[int, int]]:
    """Links i-j of at most radius bits whose sets x[i], y[j] have a Jaccard similarity of at least least, that join all such links join."""
    base = 0 if same else len(a)
    up = list(range(base + len(b)))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    sizes = np.array([len(s) for s in y], np.int64)
    # every y by its shingles: those of the shingle at place k are owners[starts[k] : starts[k + 1]]
    held = np.concatenate(y) if len(y) else np.empty(0, np.uint64)
    owners = np.repeat(np.arange(len(y)), sizes)[np.argsort(held, kind="stable")]
    shingles, times = np.unique(held, return_counts=True)
    starts = np.r_[0, np.cumsum(times)]
    out = []
    for i, j, _ in _near(a, b, same, radius):
        for k, mates in zip(i[first := np.flatnonzero(np.r_[True, i[1:] != i[:-1]])], np.split(j, first[1:])) if len(i) else ():
            k, at = int(k), root(int(k))
            mates = np.array([m for m in mates.tolist() if root(base + m) != at], np.int64)
            if not len(mates):
                continue
            if len(mates) <= FEW:
                shared = np.array([np.intersect1d(x[k], y[m], assume_unique=True).size for m in mates])
            elif len(x[k]):
                place = np.minimum(np.searchsorted(shingles, x[k]), len(shingles) - 1)
                place = place[shingles[place] == x[k]]
                n = times[place]
                ends = np.cumsum(n)
                where = np.arange(n.sum()) + np.repeat(starts[place] - ends + n, n)
                shared = np.bincount(owners[where], minlength=len(y))[mates]
            else:
                shared = np.zeros(len(mates), np.int64)
            every = len(x[k]) + sizes[mates]
            for m in mates[(shared >= least * (every - shared)) | (every == 0)].tolist():
                p, q = root(k), root(base + m)
                if p != q:
                    up[max(p, q)] = min(p, q)
                    out.append((k, m))
    return out


def _judge(width: int, words: int, radius: int, least: float):
    """Links (a, b) of each block pair from its rows (pair, same, of_a, fp, data), which follow each other; data: the text, squeezed."""

    def links_of(same: bool, rows: dict[bool, dict[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        xs, ys = sorted(rows[True]), sorted(rows[same])
        open_ = zstandard.ZstdDecompressor().decompress
        sets = [[_set(open_(rows[side][fp]).decode("utf-8", "surrogatepass"), width) for fp in fps] for side, fps in ((True, xs), (False, [] if same else ys))]
        a = _matrix(xs, words)
        found = _similar(a, a if same else _matrix(ys, words), sets[0], sets[0] if same else sets[1], same, radius, least)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([xs[i] for i, _ in found], pa.binary()), pa.array([ys[j] for _, j in found], pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one, rows = None, True, {True: {}, False: {}}
        for batch in batches:
            for pair, same, of_a, fp, data in zip(*(c.to_pylist() for c in batch.columns)):
                if pair != at:
                    if at is not None:
                        yield from links_of(one, rows)
                    at, one, rows = pair, same, {True: {}, False: {}}
                rows[of_a][fp] = data
        if at is not None:
            yield from links_of(one, rows)

    return run


def verified_links(docs: DataFrame, distinct: DataFrame, met: DataFrame, width: int, radius: int, words: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) that join what links of at most radius bits join whose shingle sets have a Jaccard similarity of at least least.

    distinct: (fp, row: id and mark of a row of docs that has it). met: block pairs (a_fps, b_fps, same, pair). A first
    reading of the pairs names the texts that are near another; these, and no others, move once to every pair that asks for them, where
    all near links between different groups are judged, each by the sets themselves. So what moves follows the texts, never their links.
    """
    spark = docs.sparkSession
    asked = cut(met.mapInArrow(_asked(words, radius), "pair long, same boolean, of_a boolean, fp binary"))
    wanted = asked.join(distinct.select("fp", row_key("row.doc_id", "row.mark").alias("key")), "fp")
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct("pair", "same", "of_a", "fp")).alias("to"))
    texts = docs.select(row_key(F.col(id_col).cast("long"), mark(text_col)).alias("key"), whole_text(text_col).alias("text"))

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, seen = zstandard.ZstdCompressor(level=3).compress, set()
        for batch in batches:
            for key, text, to in zip(*(batch.column(k) for k in ("key", "text", "to"))):
                if key.as_py() in seen:  # a repeated row
                    continue
                seen.add(key.as_py())
                to, data = to.as_py(), squeeze(text.as_py().encode("utf-8", "surrogatepass"))
                columns = [pa.array([x[c] for x in to], t) for c, t in (("pair", pa.int64()), ("same", pa.bool_()), ("of_a", pa.bool_()), ("fp", pa.binary()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([data] * len(to), pa.binary())], ["pair", "same", "of_a", "fp", "data"])

    few = asked.count() <= ASKED
    arrow_rows(spark, 512)
    sent = texts.join(F.broadcast(wanted) if few else wanted, "key").mapInArrow(squeezed, "pair long, same boolean, of_a boolean, fp binary, data binary")
    return cut(sent.repartition(partitions(spark), "pair").sortWithinPartitions("pair").mapInArrow(_judge(width, words, radius, least), "a binary, b binary"))


def row_key(row_id: Column | str, row_mark: Column | str) -> Column:
    """A row's key in joins; repeated rows share it."""
    return F.xxhash64(row_id, row_mark)


def links(distinct: DataFrame, radius: int, words: int = 1, size_ratio: float | None = None) -> DataFrame:
    """Links (a, b) between fingerprints of at most radius differing bits that keep every component whole.

    distinct: fp binary, once each (and size long, with size_ratio); bytes of fp after the fingerprint only name it. A tile holds the fingerprints of equal
    population counts in each of SEGMENTS segments of the first 64 bits (FINE_SEGMENTS beyond CROWDED fingerprints, which
    leaves fewer pairs in more tiles and the same links); a pair of tiles whose counts differ by more than
    radius in all is skipped, as its fingerprints differ by more bits. With size_ratio, tiles are bins of the
    size by that ratio instead, and bins further apart than one are skipped. Tiles are cut into blocks of
    BLOCK fingerprints, each pair of blocks is compared whole with exclusive-or and bit counts in numpy, and a
    pair of blocks returns a spanning forest, never all pairs of a group.
    """
    return _met(distinct, radius, size_ratio).mapInArrow(_compare(words, radius), "a binary, b binary")


def _met(distinct: DataFrame, radius: int, size_ratio: float | None = None) -> DataFrame:
    """The block pairs (a_fps, b_fps, same, pair) that links() compares; pair is a number of the two blocks.

    With size_ratio a block also has no more than about BLOCK_SHINGLES shingles, so that a task can hold the sets of two.
    """
    if size_ratio:
        tile, offsets = F.array(F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / F.log(F.lit(1 / size_ratio)) + 1e-9).cast("int")), [[0], [1]]
    else:
        segments = SEGMENTS if distinct.count() <= CROWDED else FINE_SEGMENTS
        tile, offsets = _popcounts(segments), _half_ball(segments, radius)
    tiled = distinct.select("fp", tile.alias("tile"), (F.col("size") if size_ratio else F.lit(0)).alias("size"))
    counts = cut(tiled.groupBy("tile").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).alias("k")))
    bounded = F.broadcast if counts.count() <= BROADCAST_TILES else lambda df: df
    counts = bounded(counts)
    blocks = cut(
        tiled.join(counts, "tile").withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("k")))
        .groupBy("tile", "sub").agg(F.collect_list("fp").alias("fps"))
    )
    moved = blocks.select("tile", "sub", F.col("fps").alias("a_fps"), F.explode(F.array(*[F.array(*map(F.lit, p)) for p in offsets])).alias("by"))
    moved = moved.select("tile", F.zip_with("tile", "by", lambda x, y: x + y).alias("to"), "sub", "a_fps", F.exists("by", lambda x: x != 0).alias("other"))
    groups = bounded(counts.select(F.col("tile").alias("to"), F.ceil(F.col("k") / MEET).alias("g")))
    left = moved.join(groups, "to").select("tile", "to", "sub", "a_fps", "other", F.explode(F.sequence(F.lit(0), (F.col("g") - 1).cast("int"))).alias("part"))
    right = blocks.join(counts, "tile").select(F.col("tile").alias("to"), F.col("sub").alias("b_sub"), F.col("fps").alias("b_fps"), F.pmod("sub", F.ceil(F.col("k") / MEET)).cast("int").alias("part"))
    met = left.join(right, ["to", "part"]).where(F.col("other") | (F.col("sub") <= F.col("b_sub")))
    arrow_rows(distinct.sparkSession, 64)
    return met.select("a_fps", "b_fps", (~F.col("other") & (F.col("sub") == F.col("b_sub"))).alias("same"), F.xxhash64("tile", "sub", "to", "b_sub").alias("pair"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, words: int = 1, min_jaccard: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document, by SimHash.

    width: words of a shingle. words: 64-bit words of a fingerprint. radius: fingerprints of so many
    differing bits or fewer link. component_id: the smallest doc_id reachable over links, itself included.
    min_jaccard: links must also have that Jaccard similarity of their shingle sets, found exactly. Fingerprints and
    sizes are then those of the distinct shingles, and texts of one fingerprint are told apart by their sets. A link that
    fails this check stands in for no other.

    Null texts are empty texts; empty texts have fingerprint zero and link to one another. Rows with a null
    doc_id keep their fingerprint and get a null component_id where nothing else shares it. Repeated rows
    stay; an empty table gives an empty result; other columns are ignored.
    """
    known, final = _grouped(docs, width, radius, words, min_jaccard, id_col, text_col)
    return known.join(final, "fp").select("doc_id", F.lower(F.hex(F.substring("fp", 1, 8 * words))).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, width: int, radius: int, words: int, min_jaccard: float | None, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of every row, and (fp, label, component_id) of each distinct one."""
    known = cut(fingerprints(docs, width, words, id_col, text_col, bool(min_jaccard)))
    distinct = cut(known.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "mark")).alias("row"), F.min("n_shingles").alias("size")))
    if min_jaccard:
        found = verified_links(docs, distinct, _met(distinct, radius, min_jaccard), width, radius, words, min_jaccard, id_col, text_col)
    else:
        found = cut(links(distinct, radius, words))
    labels = components(found)
    named = cut(distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label")))
    least = cut(named.groupBy("label").agg(F.min("first_id").alias("component_id")))
    return known, cut(named.join(least, "label").select("fp", "label", "component_id"))


def survivors(docs: DataFrame, width: int, radius: int, words: int, min_jaccard: float | None, broadcast_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each group of near_duplicates(), columns as they were: that of the smallest id, null ids last.

    Every row is judged by its id and its text, so rows that share an id go or stay each by its own group, and of a
    repeated row one stays. Up to broadcast_rows rows that go are named in a broadcast list, beyond it by a join.
    """
    known, final = _grouped(docs, width, radius, words, min_jaccard, id_col, text_col)
    rows = known.join(final, "fp").select("label", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark").alias("row"))
    best = rows.groupBy("label").agg(F.count("*").alias("n"), F.min("row").alias("best")).where("n > 1")
    judged = cut(rows.join(best, "label").groupBy("row").agg(F.min(F.col("row") == F.col("best")).alias("stays"), F.count("*").alias("n")))
    of_id, of_text = free(docs, "of_id", "of_text")
    listed = lambda which: judged.where(which).select(F.col("row.doc_id").alias(of_id), F.col("row.mark").alias(of_text))
    out, again = listed("not stays or n > 1"), listed("stays and n > 1")
    few = out.count() <= broadcast_rows
    own = F.col(id_col).cast("long").eqNullSafe(F.col(of_id)) & (mark(text_col) == F.col(of_text))
    kept = docs.join(F.broadcast(out) if few else out, own, "left_anti")
    if again.isEmpty():
        return kept
    repeated = docs.join(F.broadcast(again) if few else again, own, "left_semi")
    return kept.unionByName(repeated.withColumn(of_text, mark(text_col)).dropDuplicates([id_col, of_text]).drop(of_text))
