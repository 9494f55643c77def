"""The corpus pipeline: documents in, packed token sequences out.

Each stage works on all that its predecessor kept, and is written out before
the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilscope.llm import mixing, packing, quality, simhash, substring
from perilscope.llm.common import bounded_batches, settle, table


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars, where there is such a column, follows the text."""
    if "n_chars" not in columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    counted = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
    return docs.withColumn("n_chars", counted.cast(kind)).select(*columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    bounded_batches(spark)
    forest = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.quality_score(forest) >= 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links: fingerprints of three-word shingles, 2 bits or fewer apart."""
    bounded_batches(spark)
    return simhash.simhash_deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 20 words that occur earlier."""
    bounded_batches(spark)
    return _with_length(substring.without_repeats(docs), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document stands there as often as it is taken."""
    bounded_batches(spark)
    return _with_length(mixing.mixed_corpus(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    bounded_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: Fitted trees and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
