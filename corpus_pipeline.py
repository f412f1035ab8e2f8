"""From raw documents to ids for training: filter, deduplicate, decontaminate, redact, encode.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``.  All but the last give rows with the
columns of ``documents``; ``run`` writes each stage to the shared folder and reads it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, quality_classifier, secret_scan, simhash
from quire.llm import sentencepiece_viterbi as pieces
from quire.llm.common import free_name, table
from quire.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    name = free_name(docs, "quality_score")
    model = quality_classifier.learned(docs, table(spark, sf_dir, "labels"))
    scored = docs.withColumn(name, quality_classifier.score(docs, F.col("text"), model))
    return scored.where(quality_classifier.predicted(name) == 1).drop(name)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the row with the smallest id."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item."""
    return decontaminate.without(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; ``n_chars`` is that of the masked text."""
    name = free_name(docs, "secret_scan")
    path = F.col("source") if "source" in docs.columns else F.lit("")
    found = docs.withColumn(name, secret_scan.scan(spark, F.col("text"), path, secret_scan.fit(spark)))
    masked = F.size(f"{name}.findings") > 0
    text = F.when(masked, F.col(f"{name}.redacted")).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        length = F.char_length(f"{name}.redacted").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(masked, length).otherwise(F.col("n_chars"))
    return found.withColumns(new).drop(name)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text in place of the text, their number, and whether they decode to it.

    Columns of the documents that are called like these are replaced.
    """
    model = pieces.load(spark, public_tokenizers.path("piece_bpe_32k.model"))
    kept = [c for c in docs.columns if c.lower() not in ("text", "ids", "n_ids", "round_trip")]
    made = docs.select(*kept, pieces.transcode(F.col("text"), model).alias("_transcoded"))
    ids = F.col("_transcoded.ids")
    return made.select(*kept, ids.alias("ids"), F.size(ids).cast("long").alias("n_ids"), F.col("_transcoded.round_trip").alias("round_trip"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", dedup),
    ("benchmark decontamination", decontaminated),
    ("secret scans", secrets),
    ("SentencePiece encoding and decoding", encoded),
]

# the classifier, the fingerprints' hash and the encoder can't be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
