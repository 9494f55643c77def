"""Toxicity by compression distance, with zstandard dictionaries.

One dictionary is trained on ordinary text, one on what sets toxic text apart.
A window of a text is compressed with the ordinary dictionary alone and with
both; the bytes that the second saves say how much the window looks like toxic
text only. Counts of windows over thresholds of saved bytes are calibrated to
a probability.

Windows are single words with a fixed lead-in, in UTF-16: zstandard spends the
same few bytes on a match however short, and the wider letters keep a match of
a short word worth more than its cost. Words repeat, so a window is compressed
once for each worker.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from string import punctuation

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilscope.functions.draws import uniform
from perilscope.llm.common import held_out
from perilscope.llm.quality import labelled_sample

#: About so many labelled rows are fitted on, chosen by a hash of the id.
SAMPLE_ROWS = 8_000
#: Saved bytes from which a window counts, one count for each.
THRESHOLDS = (2, 3, 4, 6, 8, 11, 16)
ORDINARY_BYTES, TOXIC_BYTES = 131_072, 65_536
#: UTF-16 bytes of ordinary text that its dictionary is trained on, about, from all over the sample.
ORDINARY_SAMPLE = 8_000_000
CACHED_WORDS = 300_000
PREDICT_FROM = 0.7


def _words(text: str) -> list[str]:
    """Words in lower case, without punctuation at their ends (unless they are nothing else)."""
    return [w.strip(punctuation) or w for w in text.lower().split()]


def _wide(text: str) -> bytes:
    return text.encode("utf-16-le", "surrogatepass")


def _settings() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(
        window_log=19,
        hash_log=16,
        chain_log=16,
        search_log=5,
        min_match=3,
        target_length=32,
        strategy=zstandard.STRATEGY_BTOPT,
        write_content_size=0,
        write_dict_id=0,
    )


class Savings(dict):
    """Bytes that the toxic dictionary saves on a word's window, by word."""

    def __init__(self, ordinary: bytes, toxic: bytes, lead: bytes):
        super().__init__()
        self._lead = lead

        def compressor(content: bytes):
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(dict_data=raw, compression_params=_settings())

        self._ordinary = compressor(ordinary + lead)
        self._both = compressor(ordinary + toxic + lead)

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        window = self._lead + _wide(f" {word} ")
        saved = len(self._ordinary.compress(window)) - len(self._both.compress(window))
        self[word] = saved
        return saved


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    lead: bytes
    weights: np.ndarray  # of the counts, then the constant


def _counts(words: list[str], savings: Savings) -> np.ndarray:
    saved = np.fromiter(map(savings.__getitem__, words), np.int64, len(words))
    over = np.array([(saved >= t).sum() for t in THRESHOLDS], np.float64)
    return np.concatenate((np.log1p(over), np.sqrt(over / max(1, len(words))), [1.0]))


def _logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights by Newton steps; the constant, last, is not held back."""
    weights = np.zeros(rows.shape[1])
    hold = np.full(rows.shape[1], ridge)
    hold[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (labels - p) - hold * weights
        bend = (rows * (p * (1 - p))[:, None]).T @ rows + np.diag(hold)
        step = np.linalg.solve(bend, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


class Vocabulary(dict):
    """Numbers for words, in the order they are first seen."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def numbers(self, text: str) -> np.ndarray:
        words = _words(text)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _best_cut(raw: np.ndarray, labels: np.ndarray) -> float | None:
    """The value from which on predicting toxic gives the best F1, half way to the next below.

    None where that is every row: then no value tells the two apart.
    """
    order = np.argsort(-raw, kind="stable")
    values, hits = raw[order], labels[order].cumsum()
    ends = np.flatnonzero(np.append(values[1:] != values[:-1], True))  # equal values go together
    f1 = 2 * hits[ends] / (ends + 1 + labels.sum())
    at = ends[int(f1.argmax())]
    if at + 1 == len(values):
        return None
    return float(values[at] + values[at + 1]) / 2


def _contexts(texts: list[np.ndarray], size: int) -> np.ndarray:
    """How many different pairs of neighbours every word has; copies of a text add nothing."""
    keys, words = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for ids in texts:
        if not len(ids):
            continue
        around = np.concatenate(([-1], ids, [-1])).astype(np.uint64)
        key = around[:-2] * np.uint64(0x9E3779B97F4A7C15) + around[1:-1]
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + around[2:]
        keys.append(key * np.uint64(0x94D049BB133111EB))
        words.append(ids)
    _, first = np.unique(np.concatenate(keys), return_index=True)
    return np.bincount(np.concatenate(words)[first], minlength=size)


def _marked(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Words that stand in toxic texts far more often than chance would have it."""
    total = bad + good
    share = bad.sum() / max(1, total.sum())
    spread = np.sqrt(total * share * (1 - share)) + 1e-9
    return (bad >= 3) & (bad > 0.6 * total) & ((bad - total * share) / spread >= 5)


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """A trained dictionary's bytes; all samples, where they are too few to train on."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _ordinary_windows(texts: list[np.ndarray], names: list[str], room: int) -> list[bytes]:
    """Windows of 12 words from all over the texts, of about ``room`` bytes together."""
    sizes = np.fromiter((2 * len(n) + 2 for n in names), np.int64, len(names))
    share = min(1.0, room / max(1, sum(int(sizes[w].sum()) for w in texts)))
    taken, passed = [], 0
    for w in texts:
        for i in range(0, len(w), 12):
            passed += 1
            if int(passed * share) > int((passed - 1) * share):
                taken.append(_wide(" " + " ".join(names[n] for n in w[i : i + 12]) + " "))
    return taken


def train(
    texts: list[str], labels: np.ndarray, draws: np.ndarray, ordinary_sample: int = ORDINARY_SAMPLE
) -> Model:
    """Dictionaries from the texts with a draw under 0.7, calibration on the others.

    Without both labels the model is their share alone (a half without rows).
    """
    width = 2 * len(THRESHOLDS) + 1
    share = min(max(float(labels.mean()) if len(labels) else 0.5, 1e-3), 1 - 1e-3)
    constant = np.zeros(width)
    constant[-1] = math.log(share / (1 - share))
    if len(np.unique(labels)) < 2:
        return Model(b"", b"", b"", constant)
    vocabulary = Vocabulary()
    ids = [vocabulary.numbers(t) for t in texts]
    names = list(vocabulary)
    learn = draws < 0.7
    toxic = [w for w, y, u in zip(ids, labels, learn, strict=True) if y and u]
    ordinary = [w for w, y, u in zip(ids, labels, learn, strict=True) if not y and u]
    marked = _marked(_contexts(toxic, len(names)), _contexts(ordinary, len(names)))
    counts = np.bincount(np.concatenate([*toxic, np.empty(0, np.int64)]), minlength=len(names))
    kinds = {names[i]: int(counts[i]) for i in np.flatnonzero(marked)}
    # each kind of window once for every four times it occurs, so rare ones are learnt too
    windows = [f" {x} " for x, n in sorted(kinds.items()) for _ in range(1 + n // 4)]
    bad = [_wide("".join(windows[i : i + 8])) for i in range(0, len(windows), 8)]
    good = _ordinary_windows(ordinary, names, ordinary_sample)
    first = next((w[:6] for w in ordinary if len(w) >= 6), [])
    lead = _wide(" " + " ".join(names[n] for n in first) + " ")
    plain = _dictionary(good, ORDINARY_BYTES, 128)
    trained = _dictionary(bad, TOXIC_BYTES, 32)
    # the trained selection drops some windows: what room is left holds them, frequent ones last
    room = max(0, TOXIC_BYTES - len(trained))
    special = b"".join(_wide(f" {x} ") for x in sorted(kinds, key=lambda x: (kinds[x], x)))
    special = special[max(0, len(special) - room) :] + trained
    savings = Savings(plain, special, lead)
    fitted = [i for i in range(len(ids)) if not learn[i]]
    if len(set(labels[fitted].tolist())) < 2:
        return Model(plain, special, lead, constant)
    rows = np.stack([_counts([names[n] for n in ids[i]], savings) for i in fitted])
    weights = _logistic(rows, labels[fitted])
    # the calibrated cut is where a score reaches the threshold of a prediction; without one
    # the fitted chances stay, which are the share of toxic texts where nothing was saved
    cut = _best_cut(rows @ weights, labels[fitted])
    if cut is not None:
        weights[-1] += math.log(PREDICT_FROM / (1 - PREDICT_FROM)) - cut
    return Model(plain, special, lead, weights)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Train on a bounded sample of labelled documents (``rows``, in expectation)."""
    sample = labelled_sample(docs, labels, "toxic", rows)
    found = sample.select("doc_id", "text", "label", uniform("calibrate", "doc_id").alias("u"))
    frame = found.filter("text IS NOT NULL").toPandas().sort_values("doc_id", kind="stable")
    marks, draws = frame["label"].to_numpy(float), frame["u"].to_numpy(float)
    return train(frame.pop("text").tolist(), marks, draws)


def scores(model: Model, texts: pd.Series, savings: Savings) -> np.ndarray:
    rows = [_counts(_words(t) if isinstance(t, str) else [], savings) for t in texts]
    raw = np.asarray(rows, float).reshape(len(rows), len(model.weights)) @ model.weights
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def toxicity_score(model: Model, text: str = "text") -> Column:
    """The chance that a whole text is toxic; a null text counts as empty."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        savings = Savings(model.ordinary, model.toxic, model.lead)
        for texts in batches:
            yield pd.Series(scores(model, texts, savings))

    return score(F.col(text).cast("string"))


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.7 on) of every document.

    Null and empty texts save nothing and get the calibrated chance of that.
    Without labels every score is a half; with one label only, about that
    label; where no words tell the labels apart, about the share of toxic
    texts. Repeated rows are scored each; other columns are not read.
    """
    model = fit_toxicity(docs, labels, rows)
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICT_FROM).cast("int"))
