"""Pairs of questions and rows, block by block in numpy: matching words and cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a block of questions and of other rows; so many blocks of the latter are in an Arrow batch at the most.
QUESTIONS, ROWS = 256, 64
#: Different words multiplied at once, and blocks of questions that a task keeps open.
TERMS, KEPT = 4096, 40


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as tasks run at once at least: a file of one row group is one task otherwise, whatever follows."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def arrow_rows(spark: SparkSession, rows: int) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _packed(df: DataFrame, name: str, rows: int) -> DataFrame:
    """df as rows that hold up to so many of its own, in Arrow's stream format."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], [name])

    return df.mapInArrow(run, f"{name} binary")


def _opened(block) -> pa.RecordBatch:
    return pa.ipc.open_stream(block.as_buffer()).read_all().combine_chunks().to_batches()[0]


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of vectors: their lengths (-1 for a null, or one that holds a null), norms, and the places and matrix of each length."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1)).astype(np.int64)
    whole, values = pc.list_parent_indices(column), column.flatten()
    if values.null_count:
        sizes[np.unique(np.asarray(whole)[np.asarray(pc.is_null(values))])] = -1
    owner, flat = np.asarray(whole), np.asarray(pc.fill_null(values.cast(pa.float64()), 0.0))
    norms, parts = np.full(len(sizes), np.nan), []
    for size in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == size)
        matrix = flat[np.isin(owner, at)].reshape(len(at), size)
        total = np.zeros(len(at))
        for k in range(size):  # one after the other, as an aggregate over a column does
            total += matrix[:, k] * matrix[:, k]
        norms[at] = np.sqrt(total)
        parts.append((at, matrix))
    return sizes, norms, parts


class Asked:
    """A block of questions, with its terms in order and who asks for each, and its vectors."""

    def __init__(self, block: pa.RecordBatch, words: bool, emb: bool):
        self.qid, self.n = block.column("qid"), block.num_rows
        if "least" in block.schema.names:
            self.least = np.asarray(block.column("least"))
        if words:
            pairs = sorted({(t, q) for q, some in enumerate(block.column("terms").to_pylist()) for t in some or () if t is not None})
            self.terms = sorted({t for t, _ in pairs})
            number = {t: k for k, t in enumerate(self.terms)}
            self.asker = np.array([q for _, q in pairs], np.int64)
            self.starts = np.searchsorted(np.array([number[t] for t, _ in pairs], np.int64), np.arange(len(self.terms) + 1))
        if emb:
            self.has_vector = np.asarray(pc.is_valid(block.column("qvec")))
            self.vectors = _vectors(block.column("qvec"))


def cosines(column: pa.Array, asked: Asked) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of every vector with every question's, and where they are null; 0 for a zero vector, bit for bit as vectors.cosine()."""
    (a_sizes, a_norms, a_parts), (b_sizes, b_norms, b_parts) = _vectors(column), asked.vectors
    with np.errstate(all="ignore"):
        size = a_norms[:, None] * b_norms[None, :]
        dots = np.zeros(size.shape)
        for x_at, x in a_parts:
            for y_at, y in b_parts:
                if x.shape[1] == y.shape[1]:
                    total = np.zeros((len(x), len(y)))
                    for k in range(x.shape[1]):
                        total += x[:, k, None] * y[None, :, k]
                    dots[np.ix_(x_at, y_at)] = total
        out = np.where(size == 0, 0.0, dots / size)
    known = (a_sizes[:, None] >= 0) & (b_sizes[None, :] >= 0)
    return out, ~(known & ((a_sizes[:, None] == b_sizes[None, :]) | (size == 0)))


def matches(words: pa.Array, asked: Asked) -> np.ndarray:
    """How many different words of each row are terms of each question: rows x questions."""
    out = np.zeros((len(words), asked.n), np.int64)
    if not asked.terms:
        return out
    found = pc.index_in(words.flatten(), value_set=pa.array(asked.terms, words.type.value_type))
    there = np.asarray(pc.is_valid(found))
    row, term = np.asarray(pc.list_parent_indices(words))[there].astype(np.int64), np.asarray(found.drop_null()).astype(np.int64)
    once = np.unique(row * len(asked.terms) + term)
    row, term = once // len(asked.terms), once % len(asked.terms)
    held, at = np.unique(term, return_inverse=True)
    for k in range(0, len(held), TERMS):
        some, there = held[k : k + TERMS], (at >= k) & (at < k + TERMS)
        has = np.zeros((len(words), len(some)), np.float32)
        has[row[there], at[there] - k] = 1
        n = asked.starts[some + 1] - asked.starts[some]
        asks = np.zeros((len(some), asked.n), np.float32)
        asks[np.repeat(np.arange(len(some)), n), asked.asker[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(asked.starts[some], n)]] = 1
        out += (has @ asks).astype(np.int64)  # counts of so few are exact
    return out


def pairs(questions: DataFrame, rows: DataFrame, few: bool, words: bool = False, emb: bool = False) -> DataFrame:
    """Every question's qid with every row's other columns, and of the two: rel, if words, and similarity and measured, if emb.

    questions (qid, terms, qvec), rows (words, emb, ...): rel is the number of different words among the terms, similarity the
    cosine, measured whether both have a vector. Where questions have a column least, only pairs with at least that rel are put out.
    Both sides are packed into blocks, which meet in a cross join; the questions' blocks are broadcast where they are few.
    """
    kept = [f for f in rows.schema.fields if f.name not in ("words", "emb")]
    bounded = words and "least" in questions.columns
    asked = questions.select("qid", *["terms"] * words, *["qvec"] * emb, *["least"] * bounded)
    schema = StructType([asked.schema["qid"], *kept])
    schema = schema.add("rel", "long") if words else schema
    schema = schema.add("similarity", "double").add("measured", "boolean") if emb else schema
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[bytes, Asked] = {}
        for batch in batches:
            for q_block, r_block in zip(batch.column(0), batch.column(1)):
                key = q_block.as_py()
                if key not in asked:
                    if len(asked) >= KEPT:
                        asked.clear()
                    asked[key] = Asked(_opened(q_block), words, emb)
                q, r = asked[key], _opened(r_block)
                rel = matches(r.column("words"), q) if words else None
                if emb:
                    alike, null = cosines(r.column("emb"), q)
                    both = np.asarray(pc.is_valid(r.column("emb")))[:, None] & q.has_vector[None, :]
                i, j = np.nonzero(rel >= q.least[None, :] if bounded else np.ones((r.num_rows, q.n), bool))
                columns = [q.qid.take(pa.array(j)), *(r.column(f.name).take(pa.array(i)) for f in kept)]
                columns += [pa.array(rel[i, j])] if words else []
                columns += [pa.array(alike[i, j], mask=null[i, j]), pa.array(both[i, j])] if emb else []
                yield pa.RecordBatch.from_arrays(columns, names)

    arrow_rows(rows.sparkSession, ROWS)
    blocks = _packed(rows.select(*["words"] * words, *["emb"] * emb, *[F.col(f.name) for f in kept]), "r", ROWS)
    asking = F.broadcast(_packed(asked.coalesce(1), "q", QUESTIONS)) if few else _packed(asked, "q", QUESTIONS)
    met = blocks.join(asking, how="cross")
    return met.select("q", "r").mapInArrow(run, schema)
