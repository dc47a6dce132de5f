"""From raw documents to token ids: filter, deduplicate, redact, mix and encode. Part of the subpackage weft.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import mixing, pieces, quality, secrets, simhash
from weft.llm.common import cut, free, table

#: Near-duplicate stage: words of a shingle, 64-bit words of a fingerprint, bits that may differ, and the exact similarity that links need.
WIDTH, WORDS, RADIUS, SIMILARITY = 5, 4, 60, 0.8
#: Rows that leave a stage are named in a broadcast list up to this number, beyond it by a join.
BROADCAST_ROWS = 1_000_000


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality classifier accepts.

    Every row is judged by its id and text; repeated rows go or stay together, null texts are scored as empty ones, null
    ids and languages are judged like others. Without trusted labels all rows stay; an empty table stays empty.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, null ids last.

    Rows are judged by id and text: rows that share an id stay where their texts are unlike, and of a repeated row one
    stays. Null and empty texts are one group. An empty table stays empty.
    """
    return simhash.survivors(docs, WIDTH, RADIUS, WORDS, SIMILARITY, BROADCAST_ROWS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts masked; n_chars follows the text.

    Null texts stay null with a null n_chars; ids, repeated rows and order play no part; an empty table stays empty.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the raked mix selects.

    A row's chance goes by its own source, language and topic, its draw by its id: rows that share an id are drawn each
    by its own chance, repeated rows alike. Null sources, languages and topics form margins; an empty table stays empty.
    """
    drawn = mixing.mix(docs, mixing.topics_of(table(spark, sf_dir, "embeddings")))
    margins = lambda source, lang: F.xxhash64(source, lang)
    of_id, of_cell = free(docs, "of_id", "of_cell")
    left = cut(drawn.where("not selected").select(F.col("doc_id").alias(of_id), margins("source", "lang").alias(of_cell)).distinct())
    few = left.count() <= BROADCAST_ROWS
    named = lambda c: F.coalesce(c, F.lit(mixing.NONE))
    own = F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & (margins(named("source"), named("lang")) == F.col(of_cell))
    return docs.join(F.broadcast(left) if few else left, own, "left_anti")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row, with the scores of the best segmentations and the round trip's result.

    Null texts are empty and have no pieces; null ids and repeated rows stay; an empty table gives an empty result.
    """
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", filter_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each cut off from the one before."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL expresses neither fingerprints nor models: the stages are tested against brute force instead.
ORACLE_SQL = None
