"""Exact medians of all datasets, models and features at once, by counting.

A float's bits, put in order, are a whole number of four 16-bit digits. Each
pass over the packed blocks counts, for every fold and feature, the next digit
of the values that begin with the digits found so far; the middle ranks fall
into one digit, and after four passes the values are known. Counts are of
digits, so their size does not follow that of the groups, and a group that
holds most rows is counted by all tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from perilscope.operators.fold_models import NO_PART, unpacked_blocks

# Ship this module's functions with the task, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_DIGIT, _DIGITS = 16, 4
_TOP = np.uint64(1 << 63)
_COUNTS = "dataset_id string, feature int, fold int, prefix binary, digits binary, counts binary"
_FOUND = "dataset_id string, feature int, prefix binary, rank binary"


def in_order(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values, which are not NaN."""
    bits = np.ascontiguousarray(values, np.float64).view(np.uint64)
    return np.where(bits >= _TOP, ~bits, bits | _TOP)


def from_order(numbers: np.ndarray) -> np.ndarray:
    return np.where(numbers >= _TOP, numbers ^ _TOP, ~numbers).view(np.float64)


def _counted(digits: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different digits and the sums of their counts."""
    found, place = np.unique(np.concatenate(digits), return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts)).astype(np.int64)


def _narrowed(
    held: dict[tuple[int, int], tuple[list, list]], prefix: np.ndarray, rank: np.ndarray | None, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Each model's two middle values, one digit further: (k, 2) digits so far, and ranks among their equals.

    ``held`` are the counts of a dataset's feature by fold and digits so far.
    A model without values has rank -1.
    """
    counts = {key: _counted(*parts) for key, parts in held.items()}
    after, within = np.zeros((k, 2), np.uint64), np.full((k, 2), -1, np.int64)
    for i in range(k):
        for side in (0, 1):
            so_far = int(prefix[i, side])
            parts = [c for (fold, p), c in counts.items() if fold != i and p == so_far]
            if not parts or (rank is not None and rank[i, side] < 0):
                continue
            digits, n = _counted([d for d, _ in parts], [c for _, c in parts])
            ends = n.cumsum()
            wanted = (ends[-1] - 1 + side) // 2 if rank is None else rank[i, side]
            place = int(np.searchsorted(ends, wanted, side="right"))
            after[i, side] = (so_far << _DIGIT) | int(digits[place])
            within[i, side] = wanted - (ends[place - 1] if place else 0)
    return after, within


def block_medians(
    blocks: DataFrame, width: int, k: int, features: Sequence[int]
) -> dict[tuple[str, int, int], float]:
    """{(dataset_id, model, feature): median over the rows outside the model's fold}.

    The mean of the two middle values where their number is even. Missing
    values are left out; a model without values has no entry. The driver sees
    two whole numbers for each.
    """
    found: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    start = np.zeros((k, 2), np.uint64)
    for turn in range(_DIGITS):
        shared = blocks.sparkSession.sparkContext.broadcast(found)
        shift = np.uint64(64 - _DIGIT * (turn + 1))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for name, fold, x, _ in unpacked_blocks(batches, width):
                if fold == NO_PART:
                    continue
                for j in features:
                    if turn and (name, j) not in shared.value:  # noqa: B023 - used within the pass
                        continue
                    keys = in_order(x[:, j][~np.isnan(x[:, j])]) >> shift  # noqa: B023
                    before = keys >> np.uint64(_DIGIT)
                    prefixes = np.unique(shared.value[(name, j)][0]) if turn else [np.uint64(0)]  # noqa: B023
                    for prefix in prefixes:
                        digits, n = np.unique(
                            keys[before == prefix] & np.uint64((1 << _DIGIT) - 1), return_counts=True
                        )
                        if len(digits):
                            parts = held.setdefault((name, j, fold, int(prefix)), ([], []))
                            parts[0].append(digits)
                            parts[1].append(n)
                            if len(parts[0]) >= 64:
                                parts[0][:], parts[1][:] = ([c] for c in _counted(*parts))
            for (name, j, fold, prefix), parts in held.items():
                digits, n = _counted(*parts)
                values = [prefix.to_bytes(8, "little"), digits.astype("<u2").tobytes(), n.astype("<i8").tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name]),
                        pa.array([j], pa.int32()),
                        pa.array([fold], pa.int32()),
                        *(pa.array([v], pa.binary()) for v in values),
                    ],
                    names=["dataset_id", "feature", "fold", "prefix", "digits", "counts"],
                )

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def row(key: tuple[str, int], held: dict) -> pa.RecordBatch:
                prefix, rank = shared.value[key] if turn else (start, None)  # noqa: B023
                after, within = _narrowed(held, prefix, rank, k)
                columns = [pa.array([key[0]]), pa.array([key[1]], pa.int32())]
                columns += [pa.array([v.tobytes()], pa.binary()) for v in (after, within)]
                return pa.RecordBatch.from_arrays(columns, names=["dataset_id", "feature", "prefix", "rank"])

            at, held = None, {}
            for batch in batches:
                for r in batch.to_pylist():
                    key = (r["dataset_id"], r["feature"])
                    if key != at:
                        if at is not None:
                            yield row(at, held)
                        at, held = key, {}
                    parts = held.setdefault((r["fold"], int.from_bytes(r["prefix"], "little")), ([], []))
                    parts[0].append(np.frombuffer(r["digits"], "<u2").astype(np.uint64))
                    parts[1].append(np.frombuffer(r["counts"], "<i8"))
                    if len(parts[0]) >= 64:
                        parts[0][:], parts[1][:] = ([c] for c in _counted(*parts))
            if at is not None:
                yield row(at, held)

        keys = ["dataset_id", "feature"]
        counts = blocks.mapInArrow(count, _COUNTS).repartition(*keys).sortWithinPartitions(*keys)
        rows = counts.mapInArrow(narrow, _FOUND).toArrow().to_pylist()
        shared.destroy()
        found = {
            (r["dataset_id"], r["feature"]): (
                np.frombuffer(r["prefix"], np.uint64).reshape(k, 2),
                np.frombuffer(r["rank"], np.int64).reshape(k, 2),
            )
            for r in rows
        }
    return {
        (name, i, j): float((from_order(prefix[i, :1])[0] + from_order(prefix[i, 1:])[0]) / 2.0)
        for (name, j), (prefix, rank) in found.items()
        for i in range(k)
        if rank[i, 0] >= 0
    }
