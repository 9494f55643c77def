"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perilscope.llm import (
    clustering,
    html_text,
    merkle,
    mixing,
    packing,
    quality,
    sharding,
    simhash,
    spelling,
    sql,
    substring,
    token_files,
    topk,
    toxicity,
)
from perilscope.llm.common import table


def op1_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best of all embeddings for every twentieth of them."""
    return topk.top_k(table(spark, folder, "embeddings"))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents dealt into 24 shards by jump hashing of the id."""
    return sharding.shard_documents(table(spark, folder, "documents"))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Merkle fingerprints of all documents and of their edited texts."""
    return merkle.fingerprint_documents(table(spark, folder, "documents"))


def op8_html(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.extract_pages(table(spark, folder, "pages"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed by source with weights 5, 2, 1, at most three epochs."""
    return mixing.mix_documents(table(spark, folder, "documents"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their SimHash and its component at two bits or fewer."""
    return simhash.simhash_components(table(spark, folder, "documents"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """All documents scored for toxicity by compression distance."""
    labels = table(spark, folder, "labels")
    return toxicity.score_toxicity(table(spark, folder, "documents"), labels)


def op5_substring(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the passages of 20 words that occur earlier."""
    return substring.dedup_report(table(spark, folder, "documents"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """All documents scored by the quality classifier."""
    labels = table(spark, folder, "labels")
    return quality.score_quality(table(spark, folder, "documents"), labels)


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """All words of all documents with their near words, form and root."""
    return spelling.spelling_variants(table(spark, folder, "documents"))


def op12_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as token ids in ORC files, read back from them."""
    return token_files.token_report(table(spark, folder, "documents"))


def op13_clustering(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings in 16 clusters after three rounds."""
    return clustering.cluster_vectors(table(spark, folder, "embeddings"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_sharding": op2_sharding,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_substring": op5_substring,
    "op6_packing": op6_packing,
    "op7_fingerprints": op7_fingerprints,
    "op8_html": op8_html,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_spelling": op11_spelling,
    "op12_tokens": op12_tokens,
    "op13_clustering": op13_clustering,
}

ORACLES = {
    "op1_topk": sql.TOP_K,
    "op2_sharding": sql.SHARDING,
    "op7_fingerprints": sql.FINGERPRINTS,
    "op9_mixing": sql.MIXING,
    "op11_spelling": sql.SPELLING,
    "op13_clustering": sql.CLUSTERING,
}
