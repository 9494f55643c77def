"""Near duplicates: SimHash with covering locality-sensitive hashing, and shingles with min-hash bands.

``2 ** (radius + 1) - 1`` bit masks are laid over the fingerprints so that
any ``radius`` bits are left out by one mask at least. So two fingerprints
within the radius agree under some mask, and meet in that mask's table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilscope.llm.common import settle
from perilscope.llm.components import components

BITS = 64
#: Fingerprints of a bucket that are compared with one another; larger buckets are parted further.
BUCKET = 4096
#: Values that a five-word sketch keeps; texts with fewer shingles are compared exactly by it.
SKETCH = 256
#: Min-hash keys of a text, and the min-hashes in each.
BANDS, ROWS = 20, 5
#: Rounds that compare a bucket with one leader, before nodes left apart are looked at more closely.
STARS = 2
#: Odd multipliers that make other hashes of a hash.
_MULTIPLIERS = np.random.default_rng(42).integers(0, 2**64, 4096, np.uint64) | np.uint64(1)

_BIT_OF_BYTE = np.unpackbits(
    np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"
).astype(np.int64)


def words_of(text: str) -> list[bytes]:
    """Words of the whole text in UTF-8, with A to Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words, repeats included."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = (np.fromiter(map(len, words), np.int64, len(words)) + 1).cumsum()
    starts = np.concatenate(([0], ends[:-size])).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    found = (digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True))
    return np.fromiter(found, np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; none of no hashes."""
    n = len(hashes)
    if not n:
        return 0
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(n, 8)
    result = 0
    for place in range(8):
        counts = np.bincount(octets[:, place], minlength=256) @ _BIT_OF_BYTE
        for bit in np.flatnonzero(counts * 2 > n):
            result |= 1 << (8 * place + int(bit))
    return result


def fingerprint(text: str, size: int = 3) -> int:
    return majority(shingle_hashes(words_of(text), size))


def covering_masks(radius: int, places: list[int]) -> list[int]:
    """Masks over the bits ``places``: any ``radius`` of them are missing from some mask.

    Bits get vectors of radius + 1 bits in turn; the mask of a vector v holds
    the bits whose vectors are not orthogonal to v. ``radius`` vectors never
    span everything, so some v is orthogonal to all of them.
    """
    most = 2 ** (radius + 1) - 1
    return [
        sum(1 << p for i, p in enumerate(places) if ((i % most + 1) & v).bit_count() & 1)
        for v in range(1, most + 1)
    ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def buckets(prints: DataFrame, radius: int, limit: int = BUCKET) -> DataFrame:
    """(fps, nodes): buckets of two or more rows of ``prints`` (band, fp, node), distinct in band and fp.

    A bucket with over ``limit`` fingerprints is parted by a second layer of
    masks on the bits that the first left open. What is then still open is a
    dozen bits for a radius of 2, which bounds every part.
    """
    masks = covering_masks(radius, list(range(BITS)))
    inner = []
    for mask in masks:
        free = [p for p in range(BITS) if not mask >> p & 1]
        inner.append([mask | extra for extra in covering_masks(radius, free)])
    tables = F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("tab", "mask")
    placed = prints.select("band", "fp", "node", tables).select(
        "band", "tab", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "node"
    )
    keys = ["band", "tab", "key"]
    hot = placed.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys)
    lists = F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in inner])
    parted = (
        placed.join(hot, keys, "left_semi")
        .select("band", "tab", "fp", "node", F.posexplode(F.element_at(lists, F.col("tab") + 1)).alias("sub", "mask"))
        .select(
            "band",
            (F.col("tab") * 1000 + F.col("sub") + 1000).alias("tab"),
            F.col("fp").bitwiseAND(F.col("mask")).alias("key"),
            "fp",
            "node",
        )
    )
    rows = placed.join(hot, keys, "left_anti").union(parted)
    gathered = rows.groupBy(*keys).agg(F.collect_list(F.struct("fp", "node")).alias("rows"))
    return gathered.filter(F.size("rows") > 1).select(
        F.col("rows.fp").alias("fps"), F.col("rows.node").alias("nodes")
    )


def _within(fps: np.ndarray, radius: int, block: int = 512) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of bit differences, a block at a time; over the radius counts as 255."""
    for start in range(0, len(fps), block):
        apart = np.bitwise_count(fps[start : start + block, None] ^ fps[None, :])
        apart[apart > radius] = 255
        yield start, apart


def star_links(found: DataFrame, radius: int) -> DataFrame:
    """(a, b): in every bucket, each node linked with the smallest that it is connected to there."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends: list[tuple[int, int]] = []
            for fps, nodes in zip(batch["fps"], batch["nodes"], strict=True):
                if len(fps) == 2:
                    if ((int(fps[0]) ^ int(fps[1])) & (2**64 - 1)).bit_count() <= radius:
                        ends.append((int(nodes[0]), int(nodes[1])))
                    continue
                marks, ids = np.asarray(fps, np.int64).view(np.uint64), np.asarray(nodes, np.int64)
                label, before = ids.copy(), None
                while before is None or (before != label).any():
                    before = label.copy()
                    for start, apart in _within(marks, radius):
                        near = np.where(apart < 255, label[None, :], np.iinfo(np.int64).max)
                        stop = start + len(apart)
                        label[start:stop] = np.minimum(label[start:stop], near.min(axis=1))
                moved = label != ids
                ends.extend(zip(ids[moved].tolist(), label[moved].tolist(), strict=True))
            yield pd.DataFrame(ends, columns=["a", "b"]).astype("int64")

    return found.mapInPandas(link, "a bigint, b bigint")


def simhash_components(
    docs: DataFrame, size: int = 3, radius: int = 2, limit: int = BUCKET
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Fingerprints that differ in ``radius`` bits or fewer are linked; a
    component is named by its smallest doc_id. Equal fingerprints are one
    node, so groups of copies do not grow the work. A null, empty or blank
    text has fingerprint 0 and is linked like any other. A null id names no
    component. Repeated rows are each returned. No documents: no rows.
    """

    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        values = [fingerprint(t, size) if isinstance(t, str) else 0 for t in texts]
        return pd.Series(np.array(values, np.uint64).view(np.int64))

    marked = settle(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            fp(F.col("text").cast("string")).alias("fp"),
        )
    )
    nodes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("node")))
    named = nodes.filter("node IS NOT NULL").withColumn("band", F.lit(0))
    labels = components(star_links(buckets(named, radius, limit), radius))
    least = F.coalesce("component", F.col("nodes.node")).alias("component_id")
    found = settle(
        nodes.alias("nodes").join(labels.alias("l"), F.col("nodes.node") == F.col("l.node"), "left")
        .select("fp", least)
    )
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(found, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """A key for every band: the hash of ``rows`` min-hashes, each under a multiplier of its own.

    Sets of Jaccard similarity s have a key in common with probability
    1 - (1 - s ** rows) ** bands; no hashes, no keys.
    """
    if not len(hashes):
        return []
    least = np.full(bands * rows, 2**64 - 1, np.uint64)
    for start in range(0, len(hashes), 256):
        block = hashes[start : start + 256] * _MULTIPLIERS[: bands * rows, None]
        np.minimum(least, block.min(axis=1), out=least)
    octets = least.reshape(bands, rows)
    return [_signed(xxhash.xxh64_intdigest(octets[band].tobytes(), band)) for band in range(bands)]


def describe(text: str, size: int, bands: int, rows: int = ROWS) -> tuple[bytes, list[int], bytes]:
    """Digest of the word sequence, ``bands`` min-hash keys of its ``size``-word shingles, and a sketch.

    The sketch holds the smallest hashes of different shingles.
    """
    words = words_of(text)
    digest = hashlib.md5(b" ".join(words)).digest()
    hashes = np.unique(shingle_hashes(words, size))
    sketch = np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:SKETCH]
    return digest, band_keys(hashes, bands, rows), sketch.tobytes()


def likeness(left: bytes, right: bytes) -> float:
    """Jaccard similarity of the sets behind two sketches; exact where neither was cut."""
    a, b = np.frombuffer(left, np.uint32), np.frombuffer(right, np.uint32)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)
    if max(len(a), len(b)) == SKETCH:
        union = union[:SKETCH]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, union, assume_unique=True).sum() / len(union))


def verdict(left: bytes, right: bytes, similarity: float) -> bool | None:
    """Whether two sketches' sets have the similarity; None within five standard errors of it."""
    found = likeness(left, right)
    margin = 5 * (similarity * (1 - similarity) / SKETCH) ** 0.5
    if max(len(left), len(right)) == 4 * SKETCH and abs(found - similarity) < margin:
        return None
    return found >= similarity


def _shared(left: Column, right: Column) -> Column:
    """Jaccard similarity of two whole sets of hashes, as arrays without repeats."""
    both = F.size(F.array_intersect(left, right))
    return both / F.greatest(F.lit(1), F.size(left) + F.size(right) - both)


def _whole_sets(ids: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, shingles): the different shingle hashes of the whole texts of the nodes ``ids``."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts are taken one by one; a batch goes out at a megabyte of hashes."""

        def columns() -> pa.RecordBatch:
            shingles = pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), shingles],
                names=["node", "digest", "shingles"],
            )

        ids, digests, sets = [], [], []
        for batch in batches:
            for node, text in zip(batch.column("node"), batch.column("text"), strict=True):
                words = words_of(text.as_py() or "")
                ids.append(node.as_py())
                digests.append(hashlib.md5(b" ".join(words)).digest())
                sets.append(np.unique(shingle_hashes(words, size)))
                if sum(map(len, sets)) >= 1 << 17 or len(sets) >= 250:
                    yield columns()
                    ids, digests, sets = [], [], []
        if ids:
            yield columns()

    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("string").alias("text")
    )
    return settle(
        texts.join(ids, "node", "left_semi")
        .mapInArrow(whole, "node bigint, digest binary, shingles array<bigint>")
        .join(nodes.select("node", "digest"), ["node", "digest"], "left_semi")
        .dropDuplicates(["node", "digest"])
        .select("node", "shingles")
    )


def _judged(
    pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, similarity: float
) -> DataFrame:
    """The (a, b) of ``pairs`` that have the similarity, those in doubt by their whole shingle sets."""

    @F.pandas_udf("boolean")
    def by_sketch(left: pd.Series, right: pd.Series) -> pd.Series:
        both = zip(left, right, strict=True)
        return pd.Series([verdict(a, b, similarity) for a, b in both], dtype=object)

    sketches = nodes.select("node", "sketch")
    seen = settle(
        pairs.join(sketches.toDF("a", "left"), "a")
        .join(sketches.toDF("b", "right"), "b")
        .select("a", "b", by_sketch("left", "right").alias("near"))
    )
    sure, doubt = seen.filter("near").select("a", "b"), seen.filter("near IS NULL").select("a", "b")
    ids = doubt.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _whole_sets(ids, nodes, docs, size)
    exact = (
        doubt.join(sets.toDF("a", "left"), "a")
        .join(sets.toDF("b", "right"), "b")
        .filter(_shared(F.col("left"), F.col("right")) >= similarity)
        .select("a", "b")
    )
    return settle(sure.union(exact).distinct())


def _labelled(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """``members`` with the component that the links give every node."""
    if links is None:
        return members.withColumn("label", F.col("node"))
    found = members.join(components(links), "node", "left")
    return settle(found.select(*members.columns, F.coalesce("component", "node").alias("label")))


def _leaders(placed: DataFrame, turn: int) -> DataFrame:
    """A node of each bucket that holds several labels, another one each turn."""
    order = F.struct(F.xxhash64("node", F.lit(turn)), "node", "label")
    found = placed.groupBy("band", "key").agg(
        F.min(order).alias("top"), F.min("label").alias("lo"), F.max("label").alias("hi")
    )
    return settle(
        found.filter("lo <> hi").select(
            "band", "key", F.col("top.node").alias("first"), F.col("top.label").alias("first_label")
        )
    )


def _ordered(a: Column | str, b: Column | str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


# ---- nodes that leaders leave apart ----------------------------------------


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, node, n, reach): the rarest shingles of each node, those that another node has too.

    Shingles are put in order of how many nodes have them, the rarest first.
    Two sets of the similarity have one of their first n - ceil(similarity * n)
    + 1 shingles in common. If the first that they have in common stands at
    place i, at most n - i are: ``reach`` is how large the other set can then be.
    """
    rows = sets.select("node", F.size("shingles").cast("bigint").alias("n"), F.explode("shingles").alias("key"))
    often = settle(rows.groupBy("key").count().filter("count > 1"))
    held = (
        rows.join(often, "key")
        .groupBy("node", "n")
        .agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("common"))
        .withColumn("alone", F.col("n") - F.size("common"))
        .withColumn("most", F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1 - F.col("alone"))
        .filter("most > 0")
    )
    placed = held.select(
        "node",
        "n",
        "alone",
        F.posexplode(F.expr("slice(common, 1, CAST(most AS INT))")).alias("place", "shingle"),
    )
    rest = F.col("n") - F.col("alone") - F.col("place")
    reach = F.floor(rest * ((1 + similarity) / similarity) + 1e-9) - F.col("n")
    return settle(placed.select(F.col("shingle.key").alias("key"), "node", "n", reach.alias("reach")))


def _first_by_reach(placed: DataFrame, turn: int) -> DataFrame:
    """Of each key with several labels the node that reaches furthest for its size; later any node."""
    far = -F.col("reach") / F.col("n") if turn == 0 else F.lit(0.0)
    order = F.struct(far.alias("far"), F.xxhash64("node", F.lit(turn)).alias("draw"), "node", "label", "n", "reach")
    found = placed.groupBy("key").agg(
        F.min(order).alias("top"), F.min("label").alias("lo"), F.max("label").alias("hi")
    )
    return settle(
        found.filter("lo <> hi").select(
            "key",
            F.col("top.node").alias("first"),
            F.col("top.label").alias("first_label"),
            F.col("top.n").alias("other_n"),
            F.col("top.reach").alias("other_reach"),
        )
    )


def _live_cells(placed: DataFrame) -> DataFrame:
    """(key, one, two): classes of a key's nodes that may hold pairs in reach with different labels.

    A class is a range of sizes and reaches, 2 % wide; so a key has a bounded
    number of them, however many nodes it has.
    """
    classes = placed.groupBy("key", "class").agg(
        F.min("n").alias("n"), F.max("reach").alias("reach"), F.min("label").alias("lo"), F.max("label").alias("hi")
    )
    gathered = classes.groupBy("key").agg(
        F.collect_list(F.struct("class", "n", "reach", "lo", "hi")).alias("c"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    fields = ("class", "n", "reach", "lo", "hi")
    listed = gathered.filter("lo <> hi").select("key", *[F.col(f"c.{f}").alias(f) for f in fields])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, *columns in batch.itertuples(index=False):
                name, n, reach, lo, hi = (np.asarray(x, np.int64) for x in columns)
                for at in range(len(n)):
                    rest = slice(at, None)
                    live = (n[at] <= reach[rest]) & (n[rest] <= reach[at])
                    live &= (lo[at] != hi[rest]) | (hi[at] != lo[rest])
                    two = name[rest][live]
                    if len(two):
                        yield pd.DataFrame({"key": key, "one": name[at], "two": two})

    return settle(listed.mapInPandas(meet, "key bigint, one bigint, two bigint"))


def _unlike_in_reach(placed: DataFrame, block: int) -> DataFrame:
    """(a, b): nodes of a key that are in reach of one another and have different labels.

    Only classes that may hold such pairs meet, in slices of about ``block`` nodes.
    """
    bins = 1 / np.log(1.02)
    size, far = (F.floor(F.log(F.col(c).cast("double")) * bins) for c in ("n", "reach"))
    placed = settle(placed.withColumn("class", size * 100_000 + far))
    cells = _live_cells(placed)
    slices = placed.groupBy("key", "class").agg(F.ceil(F.count("*") / block).cast("int").alias("s"))
    sliced = placed.join(slices, ["key", "class"]).withColumn("own", F.expr("CAST(pmod(xxhash64(node, 'slice'), s) AS INT)"))
    cells = (
        cells.join(slices.toDF("key", "one", "s_one"), ["key", "one"])
        .join(slices.toDF("key", "two", "s_two"), ["key", "two"])
        .withColumn("i", F.explode(F.expr("sequence(0, s_one - 1)")))
        .withColumn("j", F.explode(F.expr("sequence(0, s_two - 1)")))
        .filter("one <> two OR i <= j")
        .withColumn("cell", F.xxhash64("key", "one", "two", "i", "j"))
    )
    sides = [
        sliced.join(
            cells.select("key", F.col(name).alias("class"), F.col(at).alias("own"), "cell"), ["key", "class", "own"]
        ).select("cell", F.lit(name == "two").alias("right"), "node", "label", "n", "reach")
        for name, at in (("one", "i"), ("two", "j"))
    ]
    fields = ("right", "node", "label", "n", "reach")
    gathered = sides[0].union(sides[1]).groupBy("cell").agg(F.collect_list(F.struct(*fields)).alias("m"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for columns in batch.itertuples(index=False):
                right, node, label, n, reach = (np.asarray(x, np.int64) for x in columns)
                x, y = np.flatnonzero(right == 0), np.flatnonzero(right == 1)
                close = (n[x][:, None] <= reach[y]) & (n[y] <= reach[x][:, None])
                i, j = np.nonzero(close & (label[x][:, None] != label[y]))
                one, two = node[x[i]], node[y[j]]
                yield pd.DataFrame({"a": np.maximum(one, two), "b": np.minimum(one, two)})

    listed = gathered.select(*[F.col(f"m.{f}").alias(f) for f in fields])
    return listed.mapInPandas(meet, "a bigint, b bigint")


def _links_by_prefix(
    stuck: DataFrame, links: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, similarity: float, block: int
) -> DataFrame:
    """``links`` and those still missing among the nodes ``stuck``, by an exact prefix filter.

    The texts of a family that is just below the similarity differ in rare
    shingles; these come first, so such texts are out of one another's reach
    wherever they meet. Nodes of a shingle are compared with the one that
    reaches furthest, then with another one, then any two in reach that no
    links connect yet.
    """
    members = _prefixes(_whole_sets(stuck, nodes, docs, size), similarity)
    for turn in range(STARS + 1):
        placed = _labelled(members, links)
        if turn < STARS:
            mixed = _first_by_reach(placed, turn)
            if mixed.isEmpty():
                break
            near = placed.join(mixed, "key").filter(
                "label <> first_label AND n <= other_reach AND other_n <= reach"
            )
            pairs = near.select(*_ordered("node", "first"))
        else:
            pairs = _unlike_in_reach(placed, block)
        links = links.union(_judged(settle(pairs.distinct()), nodes, docs, size, similarity))
    return links


def near_duplicate_groups(
    docs: DataFrame,
    size: int = 5,
    similarity: float = 0.8,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = 256,
) -> DataFrame:
    """(doc_id, group_id, digest) of every document; a group is named by its smallest doc_id.

    Documents are in a group if their word sequences are equal, or if they are
    connected by pairs whose ``size``-word shingles have at least the
    ``similarity``. Candidates share one of ``bands`` min-hash keys of shingles
    (0.9996 of the pairs at 0.8). In each bucket of a key, nodes are compared
    with one leader, twice. Nodes of buckets that verified links do not connect
    yet go through an exact prefix filter on their whole shingle sets.
    """

    kinds = {"digest": pa.binary(), "prints": pa.list_(pa.int64()), "sketch": pa.binary()}

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts are taken one by one, and 500 go out at a time."""
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = [describe(t.as_py() or "", size, bands, rows) for t in part.column("text")]
                columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *columns], names=["doc_id", *kinds]
                )

    marked = settle(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
        ).mapInArrow(described, "doc_id bigint, digest binary, prints array<bigint>, sketch binary")
    )
    nodes = settle(
        marked.filter("doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min_by(F.struct("prints", "sketch"), "doc_id").alias("s"), F.min("doc_id").alias("node"))
        .select("digest", "node", "s.*")
    )
    members = nodes.select("node", F.posexplode("prints").alias("band", "key"))
    links, placed = None, _labelled(members, None)
    for turn in range(STARS + 1):
        mixed = _leaders(placed, turn)
        if mixed.isEmpty():
            break
        if turn == STARS:
            stuck = settle(placed.join(mixed.select("band", "key"), ["band", "key"]).select("node").distinct())
            links = _links_by_prefix(stuck, links, nodes, docs, size, similarity, block)
            break
        near = placed.join(mixed, ["band", "key"]).filter("label <> first_label")
        found = _judged(settle(near.select(*_ordered("node", "first")).distinct()), nodes, docs, size, similarity)
        links = found if links is None else links.union(found)
        placed = _labelled(members, links)
    named = nodes.select("digest", "node")
    if links is None:
        named = named.withColumn("group_id", F.col("node"))
    else:
        named = named.join(components(links), "node", "left").select(
            "digest", F.coalesce("component", "node").alias("group_id")
        )
    return marked.select("doc_id", "digest").join(settle(named.select("digest", "group_id")), "digest", "left")


def near_deduplicated(docs: DataFrame, **how) -> DataFrame:
    """One document of each group of near duplicates: the rows of its smallest doc_id, once.

    All columns of ``docs`` stay. Of rows with one id the one whose text has
    the smallest hash stays. Rows with a null id have no group; they all stay.
    Null, empty and blank texts are one group.
    """
    return _first_of_each(docs, near_duplicate_groups(docs, **how), "group_id")


def simhash_deduplicated(docs: DataFrame, **how) -> DataFrame:
    """One document of each component of linked SimHash fingerprints (see ``simhash_components``).

    Columns, repeated ids and null ids are treated as in ``near_deduplicated``.
    """
    return _first_of_each(docs, simhash_components(docs, **how), "component_id")


def _first_of_each(docs: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    firsts = groups.filter(F.col("doc_id") == F.col(group)).select(F.col(group).alias("__first")).distinct()
    kept = docs.join(settle(firsts), F.col("doc_id").cast("bigint") == F.col("__first"))
    in_turn = Window.partitionBy("__first").orderBy(F.xxhash64("text"))
    single = kept.withColumn("__turn", F.row_number().over(in_turn)).filter("__turn = 1")
    return single.select(*docs.columns).union(docs.filter("doc_id IS NULL"))
