"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.lineage import cut

#: Edges that a task contracts at once.
HELD = 200_000


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number reachable from each of n over edges a, b."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return np.array([root(x) for x in range(n)], np.int64)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task as stars, in both directions: every node with the least node that its edges reach, HELD edges at a time."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        held.clear()
        coded = pa.concat_arrays([*rows.column(0).chunks, *rows.column(1).chunks]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ends = place[coded.indices.to_numpy()]
        roots = _roots(ends[: rows.num_rows], ends[rows.num_rows :], len(order))
        nodes, least = coded.dictionary.take(pa.array(order)), coded.dictionary.take(pa.array(order[roots]))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([nodes, least]), pa.concat_arrays([least, nodes])], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= HELD:
            yield out()
    if held:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b); label is the smallest node reachable.

    Each task first turns its edges into stars, so that long chains do not reach the shuffles. Then least labels of neighbours and
    one step of pointer jumping a round, so rounds grow with the logarithm of the longest chain of stars; each round is
    checkpointed. Rows with a null end are left out; self links do no harm. Both joins read tables keyed by node, which the adaptive skew join splits.
    """
    ends = edges.select("a", "b").where("a is not null and b is not null")
    kind = T.StructType([T.StructField(c, ends.schema["a"].dataType) for c in ("a", "b")])
    pairs = cut(ends.mapInArrow(_stars, kind).distinct())
    labels = cut(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = pairs.join(labels, pairs.b == labels.node).select(F.col("a").alias("node"), "label")
        least = cut(near.union(labels).groupBy("node").agg(F.min("label").alias("label")))
        higher = least.select(F.col("node").alias("label"), F.col("label").alias("up"))
        fresh = cut(least.join(higher, "label").select("node", F.least("up", "label").alias("label")))
        moved = fresh.alias("n").join(labels.alias("o"), "node").where("n.label != o.label").limit(1).count()
        labels = fresh
        if not moved:
            return labels
