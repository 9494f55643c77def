"""Document fingerprints: a Merkle tree over sections and paragraphs.

Sections end at a blank line, paragraphs at a line's end. Equal roots mean
equal texts; where roots differ, the branches that differ locate the edits.
A fingerprint is the root with a sketch of the tree's leaves, blocks of a
paragraph, so that two fingerprints alone also tell how much two texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilscope.llm.common import settle, text_or_empty

BLOCK = 32
SKETCH = 64


def _joined_hash(kind: str, hashes: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), F.array_join(hashes, "|")), 256)


def _paragraph_hashes(section: Column) -> Column:
    return F.transform(F.split(section, "\n", -1), lambda p: F.sha2(p, 256))


def _section_hashes(text: Column) -> Column:
    return F.transform(
        F.split(text, "\n\n", -1), lambda s: _joined_hash("section|", _paragraph_hashes(s))
    )


def root(text: Column) -> Column:
    return _joined_hash("document|", _section_hashes(text))


def leaf_marks(text: Column) -> Column:
    """The smallest different leaf hashes (8 hex digits of MD5), in order."""
    blocks = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{BLOCK}}}"), F.lit(0))
    marks = F.transform(blocks, lambda b: F.substring(F.md5(b.cast("binary")), 1, 8))
    return F.slice(F.array_sort(F.array_distinct(marks)), 1, SKETCH)


def fingerprint(text: Column) -> Column:
    """Root and leaf sketch as a string, at most 577 characters whatever the text's length."""
    return F.concat(root(text), F.lit(":"), F.array_join(leaf_marks(text), ""))


def likeness(left: Column, right: Column) -> Column:
    """About the share of leaves that two fingerprints' texts have in common, 0 to 1.

    The smallest marks of both together are a sample of all leaves; the part
    found on both sides estimates their Jaccard similarity j, and 2j / (1 + j)
    is the common part of texts of one length. Equal roots are 1, exactly.
    """

    def marks(print_: Column) -> Column:
        return F.regexp_extract_all(F.substring(print_, 66, 8 * SKETCH), F.lit(".{8}"), F.lit(0))

    union = F.slice(F.array_sort(F.array_union(marks(left), marks(right))), 1, SKETCH)
    common = F.array_intersect(F.array_intersect(union, marks(left)), marks(right))
    share = F.size(common) / F.greatest(F.size(union), F.lit(1))
    same = F.substring(left, 1, 64) == F.substring(right, 1, 64)
    return F.when(same, 1.0).otherwise(2 * share / (1 + share))


def tree(docs: DataFrame) -> DataFrame:
    """The tree as rows: doc_id, section, paragraph (from 0) and the hashes root, section_hash, hash.

    A null text is an empty one: a single empty paragraph.
    """
    text = docs.select("doc_id", text_or_empty().alias("text"))
    sections = text.select(
        "doc_id", root(F.col("text")).alias("root"),
        F.posexplode(F.split("text", "\n\n", -1)).alias("section", "body"),
    )
    hashed = sections.select(
        "doc_id", "root", "section", _paragraph_hashes(F.col("body")).alias("paragraphs")
    ).withColumn("section_hash", _joined_hash("section|", F.col("paragraphs")))
    return hashed.select(
        "doc_id", "section", F.posexplode("paragraphs").alias("paragraph", "hash"),
        "root", "section_hash",
    )


def edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, section, paragraph, change) where two trees differ, going down differing branches only."""
    keys = ["doc_id", "section", "paragraph"]

    def differing(one: DataFrame, other: DataFrame) -> DataFrame:
        branches = other.select("doc_id", "section", F.col("section_hash").alias("theirs")).distinct()
        joined = one.join(branches, ["doc_id", "section"], "left")
        return joined.filter(~F.col("section_hash").eqNullSafe(F.col("theirs"))).select(*keys, "hash")

    old = differing(before, after).withColumnRenamed("hash", "old")
    new = differing(after, before).withColumnRenamed("hash", "new")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
    both = old.join(new, keys, "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(*keys, change.otherwise("changed").alias("change"))


def next_ids(ids: DataFrame, rows: int, per_part: int = 20_000) -> DataFrame:
    """Add ``next_id``, the following doc_id in ascending order (the first, after the last).

    ``ids`` holds different ids, none null. They are range-sorted; only the
    first id of every part, a row for ``per_part`` ids, is seen in one place.
    """
    parted = settle(
        ids.repartitionByRange(rows // per_part + 1, "doc_id").withColumn(
            "_part", F.spark_partition_id()
        )
    )
    in_part = Window.partitionBy("_part").orderBy("doc_id")
    in_order = Window.orderBy("_part")
    firsts = parted.groupBy("_part").agg(F.min("doc_id").alias("_first"))
    starts = firsts.select(
        "_part",
        F.coalesce(
            F.lead("_first").over(in_order), F.min("_first").over(Window.partitionBy())
        ).alias("_start"),
    )
    following = parted.withColumn("_next", F.lead("doc_id").over(in_part))
    return following.join(starts, "_part").select(
        *ids.columns, F.coalesce("_next", "_start").alias("next_id")
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last quarter of code points replaced by as many,
    or all, from the start of the next document in the order of doc_id (after
    the last, the first). Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    A null text is an empty one. Rows with one id follow one another's
    neighbours: each is edited with the next different id, of which the
    smallest start counts. A null id has no place in the order and no next
    document: its last quarter is dropped and near_next is 0 (1 for an empty
    text). A single document is its own next one. No documents: no rows.
    """
    doc_id = F.col("doc_id")
    if dict(docs.dtypes)["doc_id"] != "bigint":
        doc_id = doc_id.cast("bigint").alias("doc_id")
    plain = docs.select(doc_id, text_or_empty().alias("text"))
    # Both sides of the join to come read the same rows, so that one shuffle serves them; for
    # that, nothing with a lambda or a new name may be worked out before it.
    texts = plain.filter("doc_id IS NOT NULL")
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    ids = settle(
        plain.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(quarter).alias("most"))
    )
    wanted = next_ids(ids, ids.count()).select(
        F.col("doc_id").alias("for_id"), "most", F.col("next_id").alias("doc_id")
    )
    heads = (
        texts.join(wanted, "doc_id")
        .select(
            F.col("for_id").alias("doc_id"),
            F.struct(
                F.expr("left(text, most)").alias("head"), fingerprint(F.col("text")).alias("print")
            ).alias("next"),
        )
        .groupBy("doc_id")
        .agg(F.min("next").alias("next"))
    )
    nothing = fingerprint(F.lit(""))
    nowhere = plain.filter("doc_id IS NULL").withColumn(
        "next", F.lit(None).cast(heads.schema["next"].dataType)
    )
    joined = texts.join(heads, "doc_id").unionByName(nowhere).select(
        "doc_id",
        F.char_length("text").cast("bigint").alias("n_chars"),
        fingerprint(F.col("text")).alias("fingerprint"),
        F.expr(
            "concat(left(text, char_length(text) - cast(floor(char_length(text) / 4) as int)),"
            " left(coalesce(next.head, ''), cast(floor(char_length(text) / 4) as int)))"
        ).alias("edited"),
        F.coalesce("next.print", nothing).alias("next_print"),
    )
    marked = joined.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return marked.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )
