"""Mixing sources to target weights by hash-random order and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perilscope.functions.draws import uniform
from perilscope.llm.common import WORD, running_sum, settle, slices_for, text_or_empty

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS
) -> DataFrame:
    """(_source, source_size, target) of every source in ``sizes`` (_source, source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    the size of all. No target passes ``most`` times its source's size; what is
    over goes to the others by weight. That ends where one level times the
    weight is given to every source below its limit: in the order of limit by
    weight, the limited ones come first, and the level is what they leave over
    the weights that remain. Rows here are sources, not documents.
    """
    totals = sizes.groupBy("_source", "source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    weighed = totals.withColumn("_weight", weight).withColumn(
        "_cap", F.col("source_size").cast("double") * most
    )
    ratio = F.col("_cap") / F.col("_weight")
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ahead = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        weighed.withColumn("_ratio", ratio)
        .withColumn("_all", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("_spent", F.coalesce(F.sum("_cap").over(ahead), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_spent")) / F.sum("_weight").over(rest))
        .withColumn("_place", F.row_number().over(by_ratio))
    )
    below = F.when(F.col("_level") <= F.col("_ratio"), F.struct("_place", "_level"))
    level = F.coalesce(F.min(below).over(everything)["_level"], F.lit(0.0))
    return levels.select(
        "_source", "source_size", F.least(F.col("_cap"), level * F.col("_weight")).alias("target")
    )


def take_by_source(
    sizes: DataFrame,
    rows: int,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_EPOCHS,
    seed: str = "mix",
) -> DataFrame:
    """Add source_size, target and taken to ``sizes`` (doc_id, source, size); it is read often.

    Every source is put in the order of a hash of the id. Its budget, the whole
    part of its target, buys full epochs first; the rest goes to the documents
    in order, and the one at the cut gives only the words that are missing.
    """
    keyed = sizes.withColumn(
        "_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    )
    targets = source_targets(keyed, weights, most)
    drawn = keyed.withColumn("_draw", uniform(seed, "doc_id"))
    placed = running_sum(
        drawn, ["_source"], "_draw", ["doc_id", "size"], "size", slices_for(rows), "_before"
    )
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return (
        placed.join(targets, "_source")
        .withColumn("taken", (epochs * F.col("size") + part).cast("bigint"))
        .drop("_source", "_draw", "_before")
    )


def document_sizes(docs: DataFrame) -> DataFrame:
    words = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("bigint")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"))


def mix_documents(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix"
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document.

    A null text has no words; a source without words has target and taken 0. A
    null source is a source, the last. A null id is drawn like an empty one.
    Repeated rows are documents of their own. No documents: no rows. Only
    doc_id, source and text are read, whatever else there is.
    """
    sizes = settle(document_sizes(docs))
    return take_by_source(sizes, sizes.count(), weights, most, seed)


def mixed_corpus(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix"
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for every time a document is taken.

    A document at its source's cut comes with its first words only, white space
    kept. Rows alike in id, source and word count are one unit here: each gives
    the same part. Documents without words are not taken.
    """
    sizes = settle(
        document_sizes(docs)
        .groupBy("doc_id", "source", "size")
        .agg(F.count(F.lit(1)).alias("__mix_alike"))
        .withColumn("__mix_one", F.col("size"))
        .withColumn("size", F.col("size") * F.col("__mix_alike"))
    )
    taken = take_by_source(sizes, sizes.count(), weights, most, seed).select(
        F.col("doc_id").alias("__mix_doc_id"),
        F.col("source").alias("__mix_source"),
        F.col("__mix_one"),
        F.floor(F.col("taken") / F.col("__mix_alike")).alias("__mix_taken"),
    )
    words = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("bigint")
    rows = docs.withColumn("__mix_words", words)
    same = (
        rows["doc_id"].eqNullSafe(taken["__mix_doc_id"])
        & rows["source"].cast("string").eqNullSafe(taken["__mix_source"])
        & (rows["__mix_words"] == taken["__mix_one"])
    )
    whole = F.floor(F.col("__mix_taken") / F.col("__mix_one")).cast("int")
    part = (F.col("__mix_taken") % F.col("__mix_one")).cast("int")
    # one entry for each whole copy (null: all words), then one for the part
    lengths = F.concat(
        F.array_repeat(F.lit(None).cast("int"), whole),
        F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")),
    )
    spaced = F.regexp_extract_all(F.col("text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    text = F.when(F.col("__mix_length").isNull(), F.col("text")).otherwise(
        F.array_join(F.slice(spaced, F.lit(1), F.coalesce(F.col("__mix_length"), F.lit(0))), "")
    )
    kept = rows.join(taken.filter(F.col("__mix_taken") > 0), same).withColumn(
        "__mix_length", F.explode(lengths)
    )
    return kept.withColumn("text", text).select(*docs.columns)
