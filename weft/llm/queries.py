"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.llm import ann, audit, decontaminate, html, licenses, lm, media, mixing, periodic, pieces, quality, secrets, simhash
from weft.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, links at three bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked tilt, probability and selection of every document; topics are the labels of embeddings."""
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.topics_of(table(spark, sf_dir, "embeddings")))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest of every vector whose id 50 divides, among all others."""
    return ann.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every whole text, with coverage and spans."""
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, its language's threshold and the verdict of every document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("k")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every whole text under the model and under word counts alone."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by the template of its host."""
    return html.main_text(table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every whole text, with the forest's score and verdict."""
    return secrets.findings(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored audio of every whole text, and the features of the bytes read back."""
    return media.audio_features(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and next best segmentations of every whole text, and whether it decodes to itself."""
    return pieces.encode(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text that lie in ten-word windows of benchmark items, and the items."""
    return decontaminate.contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep and remove in every order, by language."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every whole text, and the digest of its words without the repeats."""
    return periodic.run_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_mixing": op2_mixing,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_license_scan": op4_license_scan,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_html_extraction": op7_html_extraction,
    "op8_secret_scan": op8_secret_scan,
    "op9_media_columns": op9_media_columns,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_decontamination": op11_decontamination,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.oracle(),
    "op11_decontamination": decontaminate.oracle(),
    "op12_filter_audit": audit.oracle(),
    "op13_periodic_runs": periodic.oracle(),
}
