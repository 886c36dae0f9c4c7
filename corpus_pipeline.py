"""A corpus pipeline of five stages over ``documents``.

Each stage works on all that the one before it kept: rejects of the quality
classifier go, one document of each near-duplicate group stays, documents that
contain a test item go, secrets are masked in the text, and what is left is
tokenized and packed. Stages read their predecessor's written result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonkit.llm import decontam, packing, quality, secrets, simhash
from horizonkit.llm.common import unused
from horizonkit.llm.queries import THRESHOLD, learnable, table, vocabulary
from horizonkit.session import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold stay."""
    score = unused(docs, "__score")
    scored = quality.score_quality(docs, learnable(table(spark, sf_dir, "labels"), "quality"), out=score)
    return scored.where(F.col(score) >= THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest id stays."""
    return simhash.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item stay."""
    leaks = unused(docs, "__leaks")
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"), out=leaks)
    return found.where(F.size(leaks) == 0).drop(leaks)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; a mask stands for each secret, and n_chars follows the text."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: its document, its sequence, its place there."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Hashing, learning and tokenizing stages have no SQL; tests hold the result against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
