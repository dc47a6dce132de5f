"""Approximate nearest neighbours by an inverted multi-index with exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import arrow_rows, cut

#: Centroids of each half of the vectors; cells are pairs of them.
CENTROIDS = 32
#: Vectors that the centroids are fitted on: those of least hash of the id, a bound whatever the table.
SAMPLE = 16_384
ITERATIONS = 12
#: Share of the true nearest neighbours that a walk has to reach, on queries of the sample.
TARGET_RECALL = 0.95
#: Sample queries that set the share of the index a walk covers, and the least vectors it covers.
CALIBRATION, PROBE_LEAST = 512, 2000
#: Vectors of one index block, queries of one query block, and groups of cells that a query block is sent to.
BLOCK, ASKED, GROUPS = 1024, 256, 64
SEED = 5


def train(sample: np.ndarray, k: int, iterations: int = ITERATIONS, seed: int = SEED) -> np.ndarray:
    """Lloyd's k-means from rows spread by distance; fewer centroids where there are fewer distinct rows."""
    rng = np.random.default_rng(seed)
    points = np.unique(sample, axis=0)
    if len(points) <= k:
        return points
    chosen = [points[rng.integers(len(points))]]
    least = np.full(len(points), np.inf)
    for _ in range(k - 1):
        least = np.minimum(least, ((points - chosen[-1]) ** 2).sum(axis=1))
        chosen.append(points[rng.choice(len(points), p=least / least.sum())] if least.sum() > 0 else points[0])
    centroids = np.array(chosen)
    for _ in range(iterations):
        near = nearest(points, centroids)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum(0, (points**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1)[None, :] - 2 * points @ centroids.T)


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return distances(points, centroids).argmin(axis=1)


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, need: int) -> list[int]:
    """Cells by increasing summed distance to the query's halves, by a heap, until they hold need vectors.

    first, second: the query's distances to the centroids of each half. sizes: vectors of each cell, (a, b).
    """
    order = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[order[0]], second[order[1]]
    heap, seen, cells, held = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], 0
    while heap and held < need:
        _, i, j = heapq.heappop(heap)
        n = int(sizes[order[0][i], order[1][j]])
        if n:
            cells.append(int(order[0][i]) * sizes.shape[1] + int(order[1][j]))
            held += n
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[x] + b[y], x, y))
    return cells


def needed_share(sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], half: int, k: int, target: float) -> float:
    """Share of the index that walks cover to reach target of the k nearest, from brute force within the sample."""
    n, width = len(sample), len(books[1])
    cells = nearest(sample[:, :half], books[0]) * width + nearest(sample[:, half:], books[1])
    sizes = np.bincount(cells, minlength=len(books[0]) * width).reshape(-1, width)
    asked = sample[:: max(1, n // CALIBRATION)][:CALIBRATION]
    a, b = distances(asked[:, :half], books[0]), distances(asked[:, half:], books[1])
    near = asked @ sample.T
    near[near > 1 - 1e-12] = -2  # the query itself
    top = np.argpartition(-near, min(k, n - 1), axis=1)[:, :k]
    shares = []
    for i in range(len(asked)):
        order = traverse(a[i], b[i], sizes, n)
        held = np.cumsum(sizes.ravel()[order]) / n
        place = {c: h for c, h in zip(order, held)}
        shares += [place[c] for c in cells[top[i]]]
    return float(np.quantile(shares, target, method="higher"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of rows whose vector is whole: not null, not empty, finite, not zero."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & whole & (norm > 0))


def search(vectors: DataFrame, every: int = 50, k: int = 5, centroids: int = CENTROIDS, target: float = TARGET_RECALL, probe_least: int = PROBE_LEAST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id every divides, among all other rows.

    Unit vectors are cut in halves and each half is quantised to its nearest of centroids k-means centroids, fitted
    on the SAMPLE vectors of least hash. Every vector is in the inverted index under its pair of centroids. A
    query walks pairs by summed distance with a heap until they hold a share of the index, and at least
    probe_least distinct vectors; all of these are reranked by cosine in double precision, ties by smaller id. The
    share is the one with which queries of the sample reach target of their true neighbours there.

    The index has equal vectors once, with their k + 1 smallest ids: more can never be among k nearest. Queries
    of equal vectors are walked once too. Vectors of a cell come in blocks of BLOCK and queries in blocks of ASKED,
    which are sent to each of GROUPS groups of cells, so a crowded cell is many rows.

    Rows whose vector is null, empty, zero or holds null or non-finite values take no part, nor do null ids or
    vectors of another length than the most common one. A repeated id counts once, with its least vector. Ids
    with fewer than k others return those; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    arrow_rows(spark, 4096)
    rows = valid(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = cut(rows)
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == width.n)
    sample = _unit(np.array([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]))
    half = (width.n + 1) // 2
    books = train(sample[:, :half], centroids), train(sample[:, half:], centroids) if width.n > 1 else np.zeros((1, 0))

    # equal vectors once, with the ids that can count
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    members = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    distinct = members.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column(0))) if batch.num_rows else np.empty((0, width.n))
            cells = nearest(x[:, :half], books[0]) * len(books[1]) + nearest(x[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], ["v", "ids", "cell"])

    index = cut(distinct.select("v", "ids").mapInArrow(assign, "v array<double>, ids array<long>, cell int"))
    shape = len(books[0]), len(books[1])
    sizes = np.zeros(shape[0] * shape[1], np.int64)  # bounded by the pairs of centroids
    for r in index.groupBy("cell").count().collect():
        sizes[r.cell] = r["count"]
    total = int(sizes.sum())
    need = max(probe_least, int(np.ceil(needed_share(sample, books, half, k, target) * total)))
    sizes = sizes.reshape(shape)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, qs in zip(batch.column("q_ids"), batch.column("qs")):
                x = _unit(np.array(qs.as_py()))
                a, b = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
                picks: list[dict[int, list[int]]] = [{} for _ in range(GROUPS)]
                for i in range(len(x)):
                    for c in traverse(a[i], b[i], sizes, need):
                        picks[c % GROUPS].setdefault(c, []).append(i)
                used = [g for g in range(GROUPS) if picks[g]]
                columns = [pa.array(used, pa.int32()), pa.array([q_ids.as_py()] * len(used), pa.list_(pa.int64())), pa.array([qs.as_py()] * len(used), pa.list_(pa.list_(pa.float64())))]
                columns += [pa.array([list(picks[g]) for g in used], pa.list_(pa.int32())), pa.array([list(picks[g].values()) for g in used], pa.list_(pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, ["grp", "q_ids", "qs", "pick_cells", "pick_rows"])

    asked = rows.where(F.col("vec_id") % every == 0)
    leaders = cut(asked.groupBy("v").agg(F.min("vec_id").alias("query_id")))
    q_blocks = max(1, -(-leaders.count() // ASKED))
    arrow_rows(spark, 4)
    asking = leaders.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).alias("b")).agg(F.collect_list("query_id").alias("q_ids"), F.collect_list("v").alias("qs"))
    asking = cut(asking.select("q_ids", "qs").mapInArrow(walk, "grp int, q_ids array<long>, qs array<array<double>>, pick_cells array<int>, pick_rows array<array<int>>"))
    parts = F.broadcast(spark.createDataFrame([(i, max(1, -(-int(n) // BLOCK))) for i, n in enumerate(sizes.ravel())], "cell int, parts int"))
    blocks = (
        index.join(parts, "cell").groupBy("cell", F.pmod(F.xxhash64("v"), "parts").alias("part"))
        .agg(F.collect_list("v").alias("vs"), F.collect_list("ids").alias("ids")).withColumn("grp", F.col("cell") % GROUPS)
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q_ids, rows_, vs, ids = (batch.column(c)[r].as_py() for c in ("q_ids", "picked", "vs", "ids"))
                q = np.array(batch.column("qs")[r].as_py())[rows_]
                v = np.array(vs)
                norm, q_norm = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
                near = (q @ v.T) / norm / q_norm[:, None]
                out: list[tuple] = []
                for i, row in enumerate(near):
                    least = np.partition(row, -(k + 1))[-(k + 1)] - 1e-9 if len(row) > k + 1 else -np.inf
                    kept = np.flatnonzero(row >= least)
                    exact = (v[kept] * q[i]).sum(axis=1) / (norm[kept] * q_norm[i])
                    found = sorted((-s, id_) for s, j in zip(exact.tolist(), kept.tolist()) for id_ in ids[j])[: k + 1]
                    out += [(q_ids[rows_[i]], id_, -s) for s, id_ in found]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], ["leader", "vec_id", "score"])

    arrow_rows(spark, 16)
    met = asking.join(blocks, "grp").where(F.array_contains("pick_cells", F.col("cell")))
    picked = F.element_at("pick_rows", F.array_position("pick_cells", F.col("cell")).cast("int")).alias("picked")
    met = met.select("q_ids", "qs", "vs", "ids", picked).mapInArrow(rank, "leader long, vec_id long, score double")
    best = Window.partitionBy("leader").orderBy(F.desc("score"), "vec_id")
    top = cut(met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1))
    # every query takes its leader's k + 1 nearest but itself
    same = asked.join(leaders.withColumnRenamed("query_id", "leader"), "v").select("leader", F.col("vec_id").alias("query_id"))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = same.join(top.drop("place"), "leader").where("query_id != vec_id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
