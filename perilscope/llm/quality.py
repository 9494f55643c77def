"""A quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilscope.functions.draws import uniform
from perilscope.llm.common import held_out

#: About so many labelled rows are fitted on, chosen by a hash of the id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 80, 4, 0.15, 64, 20, 1.0

_LETTER, _UPPER, _DIGIT, _SPACE, _LINE, _HIGH, _END, _PIPE, _SYMBOL = range(9)


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros((256, 9))
    for b in range(256):
        c = chr(b)
        kinds[b, _LETTER] = b < 128 and c.isalpha()
        kinds[b, _UPPER] = b < 128 and c.isupper()
        kinds[b, _DIGIT] = b < 128 and c.isdigit()
        kinds[b, _SPACE] = c in " \t\r\x0b\x0c"
        kinds[b, _LINE] = c == "\n"
        kinds[b, _HIGH] = b >= 128
        kinds[b, _END] = c in ".,;:'\"-"
        kinds[b, _PIPE] = c in "|<>{}[]()\\/="
        kinds[b, _SYMBOL] = b < 128 and c.isprintable() and not c.isalnum() and c not in " .,;:'\"-"
    return kinds


_KINDS = _byte_kinds()
_ODD_END = re.compile(rb"[^\w\s.,;:'\"\x80-\xff-](?=\s|\Z)")


def statistics(text: str) -> list[float]:
    """Numbers that describe the whole text; all are 0 for an empty one."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * 24
    size, n = len(data), len(words)
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = histogram @ _KINDS / size
    seen = histogram[histogram > 0] / size
    entropy = float(-(seen * np.log2(seen)).sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in data.split(b"\n") if line.strip()]
    line_counts = Counter(lines)
    word_counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        *shares.tolist(),
        entropy,
        float(np.log1p(n)),
        float(lengths.mean()),
        float(lengths.std()),
        float(np.log1p(lengths.max())),
        len(word_counts) / n,
        max(word_counts.values()) / n,
        pairs / max(1, n - 1),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(line_counts) / len(lines),
        max(line_counts.values()) / len(lines),
        n / len(lines),
        len(_ODD_END.findall(data)) / n,
        len(zlib.compress(data, 1)) / size,
        float(shares[_UPPER] / max(shares[_LETTER], 1e-9)),
    ]


def describe(texts: pd.Series) -> np.ndarray:
    rows = [statistics(t) if isinstance(t, str) else [0.0] * 24 for t in texts]
    return np.asarray(rows, dtype=np.float64).reshape(len(rows), 24)


@dataclass(frozen=True)
class Forest:
    """Complete binary trees as arrays: a node's children are 2i + 1 and 2i + 2.

    A node that was not split sends everything to the left.
    """

    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # trees x inner nodes; more than it goes right
    leaf: np.ndarray  # trees x leaves
    base: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        inner = self.feature.shape[1]
        every = np.arange(len(rows))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(inner.bit_length()):
                at = 2 * at + 1 + (rows[every, feature[at]] > limit[at])
            total += leaf[at - inner]
        return total

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(rows)))


def fit_forest(
    rows: np.ndarray,
    labels: np.ndarray,
    trees: int = TREES,
    depth: int = DEPTH,
    rate: float = RATE,
    bins: int = BINS,
    least: int = LEAST_ROWS,
    ridge: float = RIDGE,
) -> Forest:
    """Boost trees on logistic loss; splits are sought in histograms of binned values.

    Without both labels the forest is their share alone (a half without rows).
    """
    inner = 2**depth - 1
    share = float(labels.mean()) if len(labels) else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    width = rows.shape[1]
    feature = np.zeros((trees, inner), dtype=np.int64)
    limit = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    if len(np.unique(labels)) < 2:
        return Forest(feature[:0], limit[:0], leaf[:0], base)
    steps = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(rows[:, j], steps)) for j in range(width)]
    binned = np.stack([np.searchsorted(e, rows[:, j]) for j, e in enumerate(edges)], axis=1)
    offsets = np.arange(width) * bins
    raw = np.full(len(rows), base)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        slope, bend = labels - p, p * (1 - p)
        at = np.zeros(len(rows), dtype=np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * (width * bins) + offsets + binned).ravel()
            shape = (nodes, width, bins)
            size = nodes * width * bins

            def gathered(weights, cell=cell, size=size, shape=shape):
                each = None if weights is None else np.repeat(weights, width)
                return np.bincount(cell, each, size).reshape(shape).cumsum(axis=2)

            g, h, n = gathered(slope), gathered(bend), gathered(None)
            all_g, all_h, all_n = g[:, :1, -1:], h[:, :1, -1:], n[:, :1, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge)
            gain = gain - all_g**2 / (all_h + ridge)
            gain[(n < least) | (all_n - n < least)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for node in range(nodes):
                j, b = divmod(int(best[node]), bins)
                if gain[node, j, b] > 1e-9 and b < len(edges[j]):
                    feature[t, first + node], limit[t, first + node] = j, edges[j][b]
            split = feature[t, at]
            at = 2 * at + 1 + (rows[np.arange(len(rows)), split] > limit[t, at])
        end = at - inner
        g, h = np.bincount(end, slope, inner + 1), np.bincount(end, bend, inner + 1)
        leaf[t] = rate * g / (h + ridge)
        raw += leaf[t][end]
    return Forest(feature, limit, leaf, base)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(doc_id, text, label) of about ``rows`` labelled documents that may be learnt from.

    Null labels do not count; of several labels of one id the highest does.
    The chosen ids are few by this bound, so they are broadcast.
    """
    usable = (
        labels.filter(~held_out() & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("label"))
    )
    share = rows / max(1, usable.count())
    chosen = usable.filter(uniform("fit", "doc_id") < share)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Forest:
    """Fit the forest on statistics of a bounded sample of labelled documents."""

    @F.pandas_udf("array<double>")
    def described(texts: pd.Series) -> pd.Series:
        return pd.Series(list(describe(texts)))

    sample = labelled_sample(docs, labels, "quality", rows)
    found = sample.select("doc_id", described("text").alias("x"), "label").toPandas()
    found = found.sort_values("doc_id", kind="stable")
    x = np.asarray(found["x"].tolist(), dtype=np.float64).reshape(len(found), 24)
    return fit_forest(x, found["label"].to_numpy(dtype=np.float64))


def quality_score(forest: Forest, text: str = "text") -> Column:
    """The chance that a whole text is of good quality; a null text counts as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(forest.scores(describe(texts)))

    return score(F.col(text).cast("string"))


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5 on) of every document.

    Null and empty texts have statistics of 0 and are scored like any other.
    Without labels every score is a half; with one label only, about that
    label. Repeated rows are scored each; other columns are not read.
    """
    forest = fit_quality(docs, labels, rows)
    scored = docs.select("doc_id", held_out().alias("held_out"), quality_score(forest).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
