"""Logistic models for every dataset and fold at once.

The input is one table, ``(dataset_id, y, fold, x)``. Model i of a dataset is
trained on that dataset's rows outside fold i, and its rows in fold i are what
it scores. Rows are packed once into dense blocks, which Spark keeps, so that a
pass moves bytes instead of converting rows. Each pass over the blocks sums the
loss, gradient and curvature of all models in the tasks that hold the rows.
Spark adds the partial sums, and the task that has a model's sums takes its
damped step there and then. The driver sees a model's parameters and the state
of its search, never its curvature. A handful of passes serve all datasets and
folds together, where separate fits would need a few dozen passes each. The
sums do not depend on how rows are spread, so a dataset that holds most rows
needs no special care.

Curvature of up to ``CURVATURE_BLOCK`` parameters is summed over all rows, and
the step is Newton's. Wider models sum the gradient over all rows, and in their
first pass the curvature's diagonal; what lies beside the diagonal is worked
out, where the step is taken, on a bounded sample of rows and scaled to all by
the summed diagonal. It only shapes the steps of a limited-memory quasi-Newton
search, which begins at the minimum that the sample and the classes' sums over
all rows give: where it ends, the minimum, is that of all rows. Models of two classes on rows that many runs share are evaluated
together, in a few matrix products. Datasets are handled in waves whose sums fit
``WAVE_CELLS`` in a task.
"""

from __future__ import annotations

import pickle
import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ship this module's functions with the task, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WAVE_CELLS = 2_000_000
CURVATURE_BLOCK = 64
#: Parameters between which the sample's curvature is worked out.
_SAMPLED_BLOCK = 1024
#: Rows a wide dataset's curvature is shaped by, and bytes of them in all.
SAMPLE_ROWS, _SAMPLE_BYTES = 16_000, 32 << 20
#: Past steps that a wide model's search keeps.
_STEPS = 10
#: Steps on the sample at most, and the step, of the largest weight, that ends them: passes over all rows go on from there.
_START_STEPS, _START_TOL = 30, 1e-2
#: Numbers of a temporary array in a pass, and of a wide model's, which it goes through several times.
_CHUNK, _WIDE_CHUNK = 1 << 18, 1 << 16
#: Sizes of a logit whose exponential, and a sum of these, fit a double.
_SAFE_LOGIT = 300.0


@dataclass
class DatasetModels:
    """The k models of one dataset; arrays are indexed by model first."""

    n_classes: int
    fill: np.ndarray  # (k, d) value for a missing feature
    shift: np.ndarray  # (k, d)
    scale: np.ndarray  # (k, d)
    theta: np.ndarray  # (k, rows, d + 1); the last column is the intercept
    present: np.ndarray  # (k, n_classes) classes among the training rows
    unfinished: int = 0  # models still moving when the passes ran out
    failed: bool = False  # the loss is not a number


def parameter_rows(n_classes: int) -> int:
    """Two classes need one row of weights, more need one per class."""
    return 1 if n_classes == 2 else n_classes


def _is_wide(parameters: int) -> bool:
    return parameters > CURVATURE_BLOCK


def sent_cells(parameters: int) -> int:
    """Numbers that a task holds and sends for a model of so many parameters in one pass."""
    return 1 + parameters + (parameters if _is_wide(parameters) else parameters**2)


def _plain(models: dict[str, DatasetModels]) -> dict[str, SimpleNamespace]:
    """The same arrays in a standard type, which workers can unpickle."""
    return {name: SimpleNamespace(**vars(m)) for name, m in models.items()}


def _design(models: DatasetModels, i: int, x: np.ndarray) -> np.ndarray:
    filled = np.where(np.isnan(x), models.fill[i], x)
    z = np.empty((len(x), x.shape[1] + 1))
    z[:, :-1] = (filled - models.shift[i]) * models.scale[i]
    z[:, -1] = 1.0
    return z


def _probabilities(models: DatasetModels, i: int, z: np.ndarray) -> np.ndarray:
    logits = z @ models.theta[i].T
    if models.n_classes == 2:
        logits = np.hstack([np.zeros_like(logits), logits])
    if not models.present[i].all():
        logits[:, ~models.present[i]] = -np.inf
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _chunks(n: int, numbers: int, held: int = _CHUNK) -> Iterator[slice]:
    """Rows 0..n-1 in parts that hold about ``held`` numbers, so many a row."""
    rows = max(16, min(8192, held // max(1, numbers)))
    for at in range(0, n, rows):
        yield slice(at, min(n, at + rows))


def _label_sums(models: DatasetModels, i: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of the prepared training rows by class; the last column has the rows' number."""
    total = np.zeros((models.n_classes, x.shape[1] + 1))
    for rows in _chunks(len(y), x.shape[1] + 1):
        z = _design(models, i, x[rows])
        for j in range(z.shape[1]):
            total[:, j] += np.bincount(y[rows], z[:, j], models.n_classes)
    return total


def _exponentials(models: DatasetModels, i: int, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the exponentials of the logits less a number, their sum, and the number."""
    theta = models.theta[i]
    logits = z @ theta.T
    if models.n_classes == 2:
        logits = np.hstack([np.zeros_like(logits), logits])
    less = np.zeros(len(z))
    if not (np.abs(z).max(axis=0) @ np.abs(theta).max(axis=0) < _SAFE_LOGIT):
        less = logits[:, models.present[i]].max(axis=1)
        logits -= less[:, None]
    if not models.present[i].all():
        logits[:, ~models.present[i]] = -np.inf
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(models.n_classes), less


def _wide_sums(
    models: DatasetModels, i: int, x: np.ndarray, y: np.ndarray | None, diagonal: bool
) -> tuple[float, np.ndarray, np.ndarray | None]:
    """Loss, gradient and, if wanted, the curvature's diagonal of a wide model; without ``y`` less the labels' parts."""
    theta = models.theta[i]
    first = models.n_classes - len(theta)
    loss, gradient = 0.0, np.zeros(theta.shape)
    curvature = np.zeros(theta.shape) if diagonal else None
    for rows in _chunks(len(x), max(models.n_classes, theta.shape[1]), _WIDE_CHUNK):
        z = _design(models, i, x[rows])
        e, total, less = _exponentials(models, i, z)
        loss += float(np.log(total).sum() + less.sum())
        gradient += e[:, first:].T @ (z / total[:, None])
        if diagonal:
            e /= total[:, None]
            curvature += (e * (1.0 - e))[:, first:].T @ (z * z)
    if y is not None:
        labels = _label_sums(models, i, x, y)[first:]
        loss -= float((theta * labels).sum())
        gradient -= labels
    return loss, gradient, curvature


def _sums(models: DatasetModels, i: int, x: np.ndarray, y: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Loss, gradient and curvature of model i over some training rows; of a wide one the diagonal, if wanted."""
    shape = models.theta[i].shape
    if _is_wide(models.theta[i].size):
        loss, gradient, curvature = _wide_sums(models, i, x, y, diagonal)
        return np.concatenate([[loss], gradient.ravel(), *([curvature.ravel()] if diagonal else [])])
    two = models.n_classes == 2
    loss, gradient = 0.0, np.zeros(shape)
    curvature = np.zeros((gradient.size, gradient.size))
    for rows in _chunks(len(y), max(models.n_classes, shape[1])):
        z, own = _design(models, i, x[rows]), y[rows]
        p = _probabilities(models, i, z)
        loss -= np.log(np.maximum(p[np.arange(len(own)), own], 1e-300)).sum()
        if two:
            p = p[:, 1:]
            gradient += (p[:, 0] - (own == 1)) @ z
        else:
            gradient += p.T @ z
            for j in range(shape[1]):
                gradient[:, j] -= np.bincount(own, z[:, j], models.n_classes)
        curvature += _curvature(z, p, 0, gradient.size)
    return np.concatenate([[loss], gradient.ravel(), curvature.ravel()])


def _sums_of_runs(
    current: dict, wanted: dict, x: np.ndarray, names: list[str], ys: np.ndarray, folds: np.ndarray, begun=()
) -> Iterator[tuple[str, int, np.ndarray]]:
    """``_sums`` of every run's models over rows that the runs share, as (run, model, sums).

    Shared rows are not prepared run by run, so all models see one design. ``begun`` are
    the models that have been through a pass.
    """
    together = []
    for run, name in enumerate(names):
        for i in wanted.get(name, ()):
            m = current[name]
            if m.n_classes == 2 and m.present[i].all() and not _is_wide(m.theta[i].size):
                together.append((run, name, i))
                continue
            at = (folds[run] != i) & (folds[run] != NO_PART)
            if at.any():
                yield name, i, _sums(m, i, x[at], ys[run][at].astype(np.int32), (name, i) not in begun)
    if not together:
        return
    runs = np.array([run for run, _, _ in together])
    held = np.array([i for _, _, i in together])[:, None]
    theta = np.stack([current[name].theta[i][0] for _, name, i in together])
    count, width = theta.shape
    loss, gradient = np.zeros(count), np.zeros((count, width))
    curvature = np.zeros((count, width * width))
    for rows in _chunks(len(x), max(count, width * width)):
        z = _design(current[together[0][1]], together[0][2], x[rows])
        fold = folds[:, rows]
        part = fold[runs]
        train = (part != held) & (part != NO_PART)
        label = ys[:, rows][runs]
        logits = theta @ z.T
        small = np.exp(-np.abs(logits))
        p = np.where(logits >= 0, 1.0, small) / (1.0 + small)
        loss += np.where(train, np.log1p(small) + np.maximum(logits, 0.0) - label * logits, 0.0).sum(axis=1)
        gradient += ((p - label) * train) @ z
        curvature += (p * (1.0 - p) * train) @ (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)
    for at, (_, name, i) in enumerate(together):
        yield name, i, np.concatenate([[loss[at]], gradient[at], curvature[at]])


def _curvature(z: np.ndarray, p: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Second derivatives of the loss by the parameters lo..hi-1, which go class by class."""
    width = z.shape[1]
    parts = []  # class, its first and last column, and where they stand in the block
    for c in range(lo // width, (hi - 1) // width + 1):
        first, last = max(0, lo - c * width), min(width, hi - c * width)
        parts.append((c, first, last, c * width + first - lo, c * width + last - lo))
    total = np.zeros((hi - lo, hi - lo))
    if len(parts) > 1:  # between classes
        for at in range(0, len(z), 4096):
            some, shares = z[at : at + 4096], p[at : at + 4096]
            weighed = np.hstack([some[:, f:t] * shares[:, [c]] for c, f, t, _, _ in parts])
            total -= weighed.T @ weighed
    for c, f, t, here, there in parts:  # within a class
        own = z[:, f:t]
        total[here:there, here:there] = (own * (p[:, c] * (1 - p[:, c]))[:, None]).T @ own
    return total


def _columns(batch: pa.RecordBatch, width: int):
    """Row arrays of a batch: dataset codes and names, x, y, fold."""
    ids = batch.column("dataset_id").dictionary_encode()
    return (
        ids.indices.to_numpy(zero_copy_only=False),
        ids.dictionary.to_pylist(),
        batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width),
        batch.column("y").to_numpy(zero_copy_only=False),
        batch.column("fold").to_numpy(zero_copy_only=False),
    )


def _groups(codes: np.ndarray, fold: np.ndarray):
    """Row numbers of each (dataset code, fold) in turn."""
    if len(codes) == 0:
        return
    order = np.lexsort((fold, codes))
    c, f = codes[order], fold[order]
    starts = np.flatnonzero(np.r_[True, (np.diff(c) != 0) | (np.diff(f) != 0)])
    for lo, hi in zip(starts, [*starts[1:], len(order)]):
        yield int(c[lo]), int(f[lo]), order[lo:hi]


_BLOCK_SCHEMA = "dataset_id string, fold int, x binary, y binary, runs array<string>"
_BLOCK_NAMES = ["dataset_id", "fold", "x", "y", "runs"]
#: The fold of a row that takes no part in a run.
NO_PART = -9
_BUFFER_BYTES = 8 << 20
#: Bytes of a block of shared rows, and of a partition of them.
_RUN_BLOCK_BYTES, RUN_PART_BYTES = 1 << 20, 8 << 20
#: Bytes of rows or blocks that go to Python together.
_BATCH_BYTES = 4 << 20
#: Files of test scores for each core, at most.
_FILES_A_CORE = 8
#: Rows that are worth a partition of their own, and bytes of a core's rows that are worth a move.
SPREAD_ROWS, _SPLIT_BYTES = 20_000, 64 << 20


def _codes(values: np.ndarray) -> bytes:
    """Small whole numbers as bytes; a byte each where they fit."""
    small = not values.size or (values.min() >= -128 and values.max() <= 127)
    return np.ascontiguousarray(values, dtype="<i1" if small else "<i4").tobytes()


def _decoded(codes, n: int) -> np.ndarray:
    return np.frombuffer(codes, "<i1" if len(codes) == n else "<i4")


def _bounded_batches(df: DataFrame) -> None:
    """Blocks go to Python ``_BATCH_BYTES`` and a block at a time, unless the session has a setting of its own.

    Spark's default is 64 MB. A task holds a batch several times over: in
    buffers outside the heap that double as they grow, and again in Python.
    """
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name, None) is None:
        conf.set(name, str(_BATCH_BYTES))


def to_blocks(matrix: DataFrame, width: int) -> DataFrame:
    """Pack rows into blocks of one dataset and fold each, a bounded buffer at a time."""
    _bounded_batches(matrix)

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        codes, names, x, y, fold = _columns(batch, width)
        out: list[list] = [[], [], [], []]
        for code, f, rows in _groups(codes, fold):
            block = (
                names[code],
                f,
                np.ascontiguousarray(x[rows], dtype="<f8").tobytes(),
                y[rows].astype("<i4").tobytes(),
            )
            for column, value in zip(out, block):
                column.append(value)
        types = [pa.string(), pa.int32(), pa.binary(), pa.binary()]
        columns = [pa.array(v, t) for v, t in zip(out, types)]
        columns.append(pa.nulls(len(out[0]), pa.list_(pa.string())))
        return pa.RecordBatch.from_arrays(columns, names=_BLOCK_NAMES)

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= _BUFFER_BYTES:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return matrix.select("dataset_id", "y", "fold", "x").mapInArrow(in_task, _BLOCK_SCHEMA)


def to_run_blocks(
    rows: DataFrame, runs: list[str], width: int, labels: Callable[[pa.Table], tuple] | None = None
) -> DataFrame:
    """Pack rows that many runs share: ``x`` once, with a label and a fold for each run.

    ``rows`` is (ys array<int>, folds array<int>, x), the arrays in the order
    of ``runs``; or ``labels(table)`` makes labels and folds, by run and row, of
    some rows' other columns. A run is then a dataset like any other.
    """
    _bounded_batches(rows)

    def given(table: pa.Table) -> list[np.ndarray]:
        return [
            table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(runs)).T
            for c in ("ys", "folds")
        ]

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        both = np.concatenate((labels or given)(table))
        return _run_block(np.ascontiguousarray(x, dtype="<f8").tobytes(), both, runs)

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            size += batch.num_rows * (8 * width + 2 * len(runs))
            if size >= _RUN_BLOCK_BYTES:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    taken = rows.select("ys", "folds", "x") if labels is None else rows
    return taken.mapInArrow(in_task, _BLOCK_SCHEMA)


def _run_block(x: bytes | pa.Buffer, both: np.ndarray, runs: list[str]) -> pa.RecordBatch:
    columns = [
        pa.array([""]),
        pa.array([NO_PART], pa.int32()),
        pa.array([x], pa.binary()),
        pa.array([_codes(both)], pa.binary()),
        pa.array([runs], pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_BLOCK_NAMES)


def are_blocks(rows: DataFrame) -> bool:
    """Whether rows are packed already."""
    return rows.columns == _BLOCK_NAMES


def as_test_sides(blocks: DataFrame, width: int) -> DataFrame:
    """Blocks of shared rows where a run's rows without a part are its test side, fold 0, the others -1."""

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, x, (ys, folds), runs in _raw_blocks(batches, width):
            sides = np.where(folds == NO_PART, 0, -1)
            yield _run_block(x.tobytes(), np.concatenate([ys, sides]), runs)

    return blocks.mapInArrow(in_task, _BLOCK_SCHEMA)


def spread_run_blocks(blocks: DataFrame, width: int) -> DataFrame:
    """The blocks persisted, in partitions of about ``RUN_PART_BYTES`` at most.

    What a task holds on the way of its rows to the shuffle follows the size of
    its partition; what it sends to Python together is bounded besides. Small
    inputs often sit in one partition; theirs are spread over the cores.
    """
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    held = blocks.groupBy(F.spark_partition_id().alias("part")).agg(
        F.sum(F.length("x")).alias("x"), F.sum(F.length("x") + F.length("y")).alias("held")
    )
    x, total, most = held.agg(F.sum("x"), F.sum("held"), F.max("held")).first()
    if total is None:
        return blocks
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    n_rows = x // (8 * width)
    small = SPREAD_ROWS <= n_rows and n_rows * (width + 1) * 8 <= cores * _SPLIT_BYTES
    if not small and most <= RUN_PART_BYTES:
        return blocks
    parts = max(min(cores, n_rows // SPREAD_ROWS), -(-total // RUN_PART_BYTES))
    spread = blocks.repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
    spread.count()
    blocks.unpersist()
    return spread


def _raw_blocks(batches: Iterator[pa.RecordBatch], width: int):
    """(dataset_id, fold, x, y, None), or of shared rows (None, None, x, ys and folds by run, runs)."""
    for batch in batches:
        for name, fold, x, y, runs in zip(*(batch.column(c) for c in _BLOCK_NAMES)):
            rows = np.frombuffer(x.as_buffer(), dtype="<f8").reshape(-1, width)
            names = runs.as_py()
            if names is None:
                yield name.as_py(), fold.as_py(), rows, np.frombuffer(y.as_buffer(), dtype="<i4"), None
            else:
                both = _decoded(y.as_buffer(), 2 * len(names) * len(rows))
                yield None, None, rows, both.reshape(2, len(names), len(rows)), names


def _each_run(rows: np.ndarray, both: np.ndarray, names: list[str]):
    for run, own, parts in zip(names, *both):
        for part in np.unique(parts):
            if part != NO_PART:
                at = parts == part
                yield run, int(part), rows[at], own[at].astype(np.int32)


def unpacked_blocks(batches: Iterator[pa.RecordBatch], width: int):
    """Unpack (dataset_id, fold, x, y) from block rows; shared blocks come once for each run."""
    for name, fold, rows, labels, names in _raw_blocks(batches, width):
        if names is None:
            yield name, fold, rows, labels
        else:
            yield from _each_run(rows, labels, names)


def block_shape(blocks: DataFrame, width: int) -> DataFrame:
    """(dataset_id, fold, y, n): row counts per class."""

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for name, fold, _, y in unpacked_blocks(batches, width):
            of_class = np.bincount(y)
            for c in np.flatnonzero(of_class).tolist():
                n = int(of_class[c])
                counts[(name, fold, c)] = counts.get((name, fold, c), 0) + n
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in counts], pa.string()),
                pa.array([k[1] for k in counts], pa.int32()),
                pa.array([k[2] for k in counts], pa.int32()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            names=["dataset_id", "fold", "y", "n"],
        )

    return (
        blocks.mapInArrow(in_task, "dataset_id string, fold int, y int, n bigint")
        .groupBy("dataset_id", "fold", "y")
        .agg(F.sum("n").alias("n"))
    )


_KEYS = ["dataset_id", "key"]
_SUMS = "dataset_id string, key int, sums binary"


def _partial_sums(
    blocks: DataFrame, width: int, shared, vectors: Callable, of_runs: Callable | None = None, parts: int = 0
) -> DataFrame:
    """(dataset_id, key, sums): what a task's blocks add up to, equal keys in one task and in a row.

    ``vectors(payload, name, fold, x, y)`` yields (key, vector) of a block;
    ``of_runs(payload, x, runs, ys, folds)``, if given, (run, key, vector) of shared rows.
    ``parts`` says how many tasks add them up; else adaptive execution does, by their bytes.
    """

    def found(given, batches: Iterator[pa.RecordBatch]):
        for name, fold, x, y, runs in _raw_blocks(batches, width):
            if runs is not None and of_runs is not None:
                yield from of_runs(given, x, runs, *y)
                continue
            for each in [(name, fold, x, y)] if runs is None else _each_run(x, y, runs):
                for key, vector in vectors(given, *each):
                    yield each[0], key, vector

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shared.value
        sums: dict = {}
        for name, key, vector in found(given, batches):
            held = sums.get((name, key))
            sums[(name, key)] = vector if held is None else held + vector
        if sums:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name for name, _ in sums], pa.string()),
                    pa.array([key for _, key in sums], pa.int32()),
                    pa.array([v.tobytes() for v in sums.values()], pa.binary()),
                ],
                names=["dataset_id", "key", "sums"],
            )

    partial = blocks.mapInArrow(in_task, _SUMS)
    return partial.repartition(*([parts] if parts else []), *_KEYS).sortWithinPartitions(*_KEYS)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
    """(dataset, key, sum) of arrays whose equal keys follow one another; one is held at a time."""
    held: tuple | None = None
    total = None
    for batch in batches:
        for name, key, sums in zip(*(batch.column(c) for c in ("dataset_id", "key", "sums"))):
            values = np.frombuffer(sums.as_buffer())
            if held == (name.as_py(), key.as_py()):
                total = total + values
                continue
            if held is not None:
                yield (*held, total)
            held, total = (name.as_py(), key.as_py()), values
    if held is not None:
        yield (*held, total)


def _block_sums(
    blocks: DataFrame, width: int, payload, vectors: Callable
) -> dict[tuple[str, int], np.ndarray]:
    """One pass: {(dataset_id, key): sum of the vectors that ``vectors`` makes of each block}."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, key, total in _totals(batches):
            columns = [pa.array([name]), pa.array([key], pa.int32()), pa.array([total.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["dataset_id", "key", "sums"])

    shared = blocks.sparkSession.sparkContext.broadcast(payload)
    total = _partial_sums(blocks, width, shared, vectors).mapInArrow(added, _SUMS).toArrow()
    shared.destroy()
    return {
        (name.as_py(), key.as_py()): np.frombuffer(sums.as_buffer())
        for name, key, sums in zip(*(total[c] for c in total.column_names))
    }


def block_moments(
    blocks: DataFrame, names: list[str], width: int
) -> tuple[dict[tuple[str, int], np.ndarray], dict[str, int]]:
    """{(dataset_id, fold): (width, 3) array of count, mean and variance of the present values},
    and {dataset_id: a feature with an infinite value}.

    Squares are summed about each dataset's own mean, so nothing cancels.
    """

    def plain(_, name, fold, x, y):
        there = np.isfinite(x)
        total = np.where(there, x, 0.0).sum(axis=0)
        yield fold, np.concatenate([there.sum(axis=0), total, np.isinf(x).sum(axis=0)])

    first = _block_sums(blocks, width, None, plain)
    infinite: dict[str, int] = {}
    for (name, _), v in first.items():
        if v[2 * width :].any():
            place = int(np.flatnonzero(v[2 * width :])[0])
            infinite[name] = min(place, infinite.get(name, place))
    first = {k: v[: 2 * width] for k, v in first.items()}
    centres = {}
    for name in names:
        total = sum(v for (n, _), v in first.items() if n == name)
        centres[name] = total[width:] / np.maximum(total[:width], 1.0)

    def squares(given, name, fold, x, y):
        yield fold, np.nansum(np.where(np.isfinite(x), x - given[name], 0.0) ** 2, axis=0)

    second = _block_sums(blocks, width, centres, squares)
    moments = {}
    for (name, fold), v in first.items():
        n = np.maximum(v[:width], 1.0)
        mean = v[width:] / n
        off = mean - centres[name]
        variance = np.maximum(second[(name, fold)] / n - off**2, 0.0)
        moments[(name, fold)] = np.column_stack(
            [v[:width], np.where(v[:width] > 0, mean, 0.0), np.where(v[:width] > 0, variance, 0.0)]
        )
    return moments, infinite


def _sampled_rows(blocks: DataFrame, width: int, models: dict[str, DatasetModels], sizes: dict[str, int]) -> dict:
    """{dataset_id: (fold, x) of a bounded sample of its rows}; repeated runs draw the same of equal blocks."""
    most = min(SAMPLE_ROWS, _SAMPLE_BYTES // (8 * (width + 1) * len(models)))
    rates = {name: min(1.0, most / max(1, sizes[name])) for name in models}

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, fold, x, _ in unpacked_blocks(batches, width):
            rate = rates.get(name)
            if rate is None:
                continue
            some = x
            if rate < 1.0:
                draws = np.random.default_rng(zlib.crc32(np.ascontiguousarray(x)))
                some = x[draws.random(len(x)) < rate]
            if len(some):
                columns = [pa.array([name]), pa.array([fold], pa.int32()), pa.array([some.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["dataset_id", "fold", "x"])

    found: dict = {name: ([], []) for name in models}
    for row in blocks.mapInArrow(in_task, "dataset_id string, fold int, x binary").toArrow().to_pylist():
        x = np.frombuffer(row["x"], "<f8").reshape(-1, width)
        found[row["dataset_id"]][0].append(np.full(len(x), row["fold"]))
        found[row["dataset_id"]][1].append(x)
    return {
        name: (np.concatenate(folds), np.concatenate(parts)) if parts else (np.empty(0, int), np.empty((0, width)))
        for name, (folds, parts) in found.items()
    }


def _bends(models: DatasetModels, i: int, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(lo, hi, curvature) of a wide model over some rows, in blocks of parameters."""
    z = _design(models, i, x)
    p = _probabilities(models, i, z)
    if models.n_classes == 2:
        p = p[:, 1:]
    n = models.theta[i].size
    for lo in range(0, n, _SAMPLED_BLOCK):
        hi = min(lo + _SAMPLED_BLOCK, n)
        yield lo, hi, _curvature(z, p, lo, hi)


def _sample_share(models: DatasetModels, i: int, x: np.ndarray, diagonal: np.ndarray) -> tuple[float, np.ndarray]:
    """How often the sample's curvature is that of all rows, and what of their ``diagonal`` it lacks.

    One number for all parameters: curvature that a common change of all
    classes' weights does not have would else appear in it. Only parameters of
    which the sample has next to nothing get the rest on the diagonal.
    """
    z = _design(models, i, x)
    p = _probabilities(models, i, z)[:, models.n_classes - len(models.theta[i]) :]
    there = (p * (1.0 - p)).T @ (z * z)
    free = there[:, -1].sum()
    more = diagonal.reshape(there.shape)[:, -1].sum() / free if free > 0 else 1.0
    there = more * there.ravel()
    return more, np.where(diagonal > 4.0 * there, diagonal - there, 0.0)


def _sampled_bends(
    models: DatasetModels,
    i: int,
    fold: np.ndarray,
    x: np.ndarray,
    diagonal: np.ndarray,
    share: tuple[float, np.ndarray] | None = None,
) -> list[tuple[int, int, np.ndarray]]:
    """(lo, hi, curvature) of a wide model: the sample's, as much as ``share`` or the ``diagonal`` of all rows says."""
    x = x[fold != i]
    more, lacking = share or _sample_share(models, i, x, diagonal)
    return [(lo, hi, more * bend + np.diag(lacking[lo:hi])) for lo, hi, bend in _bends(models, i, x)]


def _solved(bend: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The shortest solution; of a large system one that a slight ridge makes unique."""
    if len(bend) > CURVATURE_BLOCK:
        return np.linalg.solve(bend + np.diag(np.full(len(bend), 1e-9 * np.diag(bend).max())), values)
    return np.linalg.lstsq(bend, values, rcond=None)[0]


def _step(
    state: dict | None, theta: np.ndarray, objective: float, gradient: np.ndarray, bends: Callable, keep: int = 0
):
    """The state of a search after a pass: where it was, its direction, and how much of it to go.

    ``bends()`` are (lo, hi, curvature) of the blocks, ``keep`` the past steps
    to learn from. A step that falls too little is halved; else the direction
    is worked out anew.
    """
    if state is not None:
        at, before, slope = state["at"], state["objective"], float(state["gradient"] @ state["direction"])
        if objective > before + 1e-4 * state["part"] * slope + 1e-10 * (1.0 + abs(before)):
            return state | {"part": state["part"] / 2.0}
    pairs = [] if state is None else state["pairs"]
    if state is not None and keep:
        moved, bent = theta - at, gradient - state["gradient"]
        if moved @ bent > 1e-12 * np.linalg.norm(moved) * np.linalg.norm(bent):
            pairs = [*pairs, (moved, bent)][-keep:]
    rest, shares = gradient.copy(), []
    for moved, bent in reversed(pairs):
        share = (moved @ rest) / (moved @ bent)
        rest -= share * bent
        shares.append(share)
    for lo, hi, bend in bends():
        rest[lo:hi] = _solved(bend, rest[lo:hi])
    for (moved, bent), share in zip(pairs, reversed(shares), strict=True):
        rest += moved * (share - (bent @ rest) / (moved @ bent))
    return {
        "at": theta, "objective": objective, "gradient": gradient, "direction": -rest, "part": 1.0, "pairs": pairs
    }


def _penalty(models: DatasetModels, i: int, inverse_penalty: float) -> np.ndarray:
    """Of each parameter; the intercepts are free."""
    weight = np.ones_like(models.theta[i]) / inverse_penalty
    weight[:, -1] = 0.0
    return weight.ravel()


def _sample_minimum(
    models: DatasetModels, i: int, x: np.ndarray, sums: np.ndarray, weight: np.ndarray
) -> np.ndarray:
    """Where the search over all training rows of a wide model begins; ``sums`` are theirs by class.

    What the loss holds besides these is the sample's, as often as the rows are
    more. So a class without a row in the sample has its share all the same.
    The classes' means are moved to the sample's: what all classes have in
    common would else be made up for by weights that hardly cost anything.
    """
    own = SimpleNamespace(**vars(models))
    own.theta = models.theta.copy()
    start, state = models.theta[i].ravel(), None
    theta = start
    if not len(x):
        return start
    total = sums.sum(axis=0)
    more = total[-1] / len(x)
    off = total / total[-1] - _design(models, i, x).mean(axis=0)
    labels = (sums - sums[:, -1:] * off)[models.n_classes - len(models.theta[i]) :].ravel()
    for _ in range(_START_STEPS):
        own.theta[i] = theta.reshape(own.theta[i].shape)
        loss, gradient, _ = _wide_sums(own, i, x, None, False)
        objective = more * loss - labels @ theta + 0.5 * (weight * theta**2).sum()
        if not np.isfinite(objective):
            return start if state is None else state["at"]

        def bends():
            return [(lo, hi, more * bend + np.diag(weight[lo:hi])) for lo, hi, bend in _bends(own, i, x)]

        slope = more * gradient.ravel() - labels + weight * theta
        state = _step(state, theta, objective, slope, bends, _STEPS)
        step = state["part"] * state["direction"]
        theta = state["at"] + step
        if np.abs(step).max() <= _START_TOL * (1.0 + np.abs(theta).max()):
            break
    return theta


def _start_wide(blocks: DataFrame, models: dict[str, DatasetModels], sample: dict, inverse_penalty: float) -> None:
    """Set the weights of wide models to the sample's minimum."""
    width = next(iter(models.values())).fill.shape[1]
    plain = _plain(models)

    def classes(given, name, fold, x, y):
        for i in range(len(given[name].theta) if name in given else 0):
            if i != fold:
                yield i, _label_sums(given[name], i, x, y)

    labels = _block_sums(blocks, width, plain, lambda *of: ((i, v.ravel()) for i, v in classes(*of)))
    keys = list(labels)
    context = blocks.sparkSession.sparkContext
    shared = context.broadcast((plain, sample, labels, keys))

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sampled, sums, names = shared.value
        for at in (at for batch in batches for at in batch.column(0).to_pylist()):
            name, i = names[at]
            fold, x = sampled[name]
            own = current[name]
            weight = _penalty(own, i, inverse_penalty)
            by_class = sums[(name, i)].reshape(own.n_classes, -1)
            theta = _sample_minimum(own, i, x[fold != i], by_class, weight)
            columns = [pa.array([name]), pa.array([i], pa.int32()), pa.array([theta.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["dataset_id", "key", "sums"])

    parts = max(1, min(len(keys), 4 * context.defaultParallelism))
    numbers = blocks.sparkSession.range(0, len(keys), 1, parts)
    for row in numbers.mapInArrow(in_task, _SUMS).toArrow().to_pylist():
        theta = models[row["dataset_id"]].theta
        theta[row["key"]] = np.frombuffer(row["sums"]).reshape(theta[row["key"]].shape)
    shared.destroy()


_STEPPED = "dataset_id string, model int, theta binary, state binary, finished boolean, failed boolean"


def fit_models(
    blocks: DataFrame,
    models: dict[str, DatasetModels],
    inverse_penalty: float = 1.0,
    max_iter: int = 2000,
    tol: float = 1e-6,
) -> dict[str, DatasetModels]:
    """Minimise the L2-penalised log loss (intercept free) of all models; changes ``models``.

    A model is done when its step is below ``tol`` times its largest weight
    (plus 1). Models still moving after ``max_iter`` passes are counted in
    their dataset's ``unfinished``; the others are not held up. A dataset whose
    loss is not a number is ``failed``.
    """
    width = next(iter(models.values())).fill.shape[1]
    active = {name: list(range(len(m.theta))) for name, m in models.items()}
    states: dict[tuple[str, int], bytes] = {}

    wide = {name: m for name, m in models.items() if _is_wide(m.theta[0].size)}
    sample = {}
    if wide:
        counts = block_shape(blocks, width).groupBy("dataset_id").agg(F.sum("n").alias("n")).toArrow().to_pylist()
        sample = _sampled_rows(blocks, width, wide, {r["dataset_id"]: r["n"] for r in counts})
        _start_wide(blocks, wide, sample, inverse_penalty)
    sampled = blocks.sparkSession.sparkContext.broadcast(sample)

    def training(given, name, fold, x, y):
        current, wanted, kept = given
        for i in wanted.get(name, ()):
            if i != fold:
                yield i, _sums(current[name], i, x, y, (name, i) not in kept)

    def training_runs(given, x, runs, ys, folds):
        yield from _sums_of_runs(given[0], given[1], x, runs, ys, folds, given[2])

    for _ in range(max_iter):
        payload = ({n: m for n, m in _plain(models).items() if n in active}, active, states)
        shared = blocks.sparkSession.sparkContext.broadcast(payload)

        def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, _, kept = shared.value  # noqa: B023 - used within the pass
            for name, i, sums in _totals(batches):
                theta = current[name].theta[i].ravel()
                n, finite = theta.size, bool(np.isfinite(sums[0]))
                state, after, finished = None, theta, True
                if finite:
                    weight = _penalty(current[name], i, inverse_penalty)
                    before = pickle.loads(kept[(name, i)]) if (name, i) in kept else None
                    rest, share = sums[1 + n :], None
                    if _is_wide(n):  # the diagonal is summed once; what it tells stays with the search
                        fold, x = sampled.value[name]
                        share = before["share"] if before else _sample_share(current[name], i, x[fold != i], rest)
                    objective = sums[0] + 0.5 * (weight * theta**2).sum()

                    def bends():
                        if _is_wide(n):  # noqa: B023 - used within the turn
                            found = _sampled_bends(current[name], i, fold, x, rest, share)  # noqa: B023
                        else:
                            found = [(0, n, rest.reshape(n, n))]  # noqa: B023
                        return [(lo, hi, bend + np.diag(weight[lo:hi])) for lo, hi, bend in found]  # noqa: B023

                    slope = sums[1 : 1 + n] + weight * theta
                    state = _step(before, theta, objective, slope, bends, _STEPS if _is_wide(n) else 0)
                    if _is_wide(n):
                        state["share"] = share
                    step = state["part"] * state["direction"]
                    after = state["at"] + step
                    finished = bool(np.abs(step).max() <= tol * (1.0 + np.abs(theta).max()))
                columns = [
                    pa.array([name]),
                    pa.array([i], pa.int32()),
                    pa.array([after.tobytes()], pa.binary()),
                    pa.array([b"" if finished else pickle.dumps(state)], pa.binary()),
                    pa.array([finished]),
                    pa.array([not finite]),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["dataset_id", "model", "theta", "state", "finished", "failed"]
                )

        parts = min(blocks.sparkSession.sparkContext.defaultParallelism, sum(map(len, active.values())))
        found = _partial_sums(blocks, width, shared, training, training_runs, parts)
        found = found.mapInArrow(stepped, _STEPPED).toArrow()
        shared.destroy()
        active, states = {}, {}
        for row in found.to_pylist():
            name, i = row["dataset_id"], row["model"]
            own = models[name]
            own.theta[i] = np.frombuffer(row["theta"]).reshape(own.theta[i].shape)
            own.failed |= row["failed"]
            if not row["finished"]:
                active.setdefault(name, []).append(i)
                states[(name, i)] = row["state"]
        if not active:
            break
    sampled.destroy()
    for name, m in models.items():
        m.unfinished = len(active.get(name, ()))
    return models


def _scored(models: DatasetModels, i: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(own label) and P(last class) of rows that model i holds out."""
    assigned, last = np.empty(len(y)), np.empty(len(y))
    for rows in _chunks(len(y), max(models.n_classes, x.shape[1])):
        p = _probabilities(models, i, _design(models, i, x[rows]))
        assigned[rows] = p[np.arange(len(p)), y[rows]]
        last[rows] = p[:, -1]
    return assigned, last


def block_scores(blocks: DataFrame, models: dict[str, DatasetModels], width: int) -> DataFrame:
    """Per dataset: mean of 1 - P(assigned label) over its held-out rows, and their number."""
    shared = blocks.sparkSession.sparkContext.broadcast(_plain(models))

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = shared.value
        sums: dict = {}
        for name, fold, x, y in unpacked_blocks(batches, width):
            if fold < 0 or name not in current:
                continue
            held = sums.setdefault(name, [0.0, 0])
            held[0] += float((1.0 - _scored(current[name], fold, x, y)[0]).sum())
            held[1] += len(y)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums), pa.string()),
                pa.array([v[0] for v in sums.values()], pa.float64()),
                pa.array([v[1] for v in sums.values()], pa.int64()),
            ],
            names=["dataset_id", "total", "n"],
        )

    return (
        blocks.mapInArrow(in_task, "dataset_id string, total double, n bigint")
        .groupBy("dataset_id")
        .agg((F.sum("total") / F.sum("n")).alias("score"), F.sum("n").alias("n_rows"))
    )


def run_test_scores(blocks: DataFrame, models: dict[str, DatasetModels], width: int) -> DataFrame:
    """(dataset_id, y, p1) of every row that a run's model 0 holds out.

    A task goes through several partitions, a batch at a time, so that the
    scores are written to a number of files that does not follow the rows':
    each file can start a process of Hadoop's, whose memory is the executor's
    own for a moment and is counted twice by those who look then.
    """
    blocks = blocks.coalesce(_FILES_A_CORE * blocks.sparkSession.sparkContext.defaultParallelism)
    shared = blocks.sparkSession.sparkContext.broadcast(_plain(models))

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = shared.value
        for name, fold, x, y in unpacked_blocks(batches, width):
            if fold == 0 and name in current:
                p = _scored(current[name], 0, x, y)[1]
                columns = [pa.array([name] * len(y)), pa.array(y, pa.int32()), pa.array(p)]
                yield pa.RecordBatch.from_arrays(columns, names=["dataset_id", "y", "p1"])

    return blocks.mapInArrow(in_task, "dataset_id string, y int, p1 double")


def score_held_out(matrix: DataFrame, models: dict[str, DatasetModels], width: int) -> DataFrame:
    """Rows that some model holds out, with ``p_assigned`` and ``p_last`` in place of ``x``.

    ``p_assigned`` is the probability of the row's own label, ``p_last`` that
    of the highest class code (class 1 of two). Both are null for the rows of a
    dataset without models.
    """
    shared = matrix.sparkSession.sparkContext.broadcast(_plain(models))
    kept = [f for f in matrix.schema.fields if f.name != "x"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = shared.value
        for batch in batches:
            assigned = np.full(batch.num_rows, np.nan)
            last = np.full(batch.num_rows, np.nan)
            codes, names, x, y, fold = _columns(batch, width)
            for code, i, rows in _groups(codes, fold):
                models_here = current.get(names[code])
                if models_here is None:
                    continue
                assigned[rows], last[rows] = _scored(models_here, i, x[rows], y[rows])
            columns = [batch.column(f.name) for f in kept]
            scores = [pa.array(p, from_pandas=True) for p in (assigned, last)]
            yield pa.RecordBatch.from_arrays(
                [*columns, *scores], names=[f.name for f in kept] + ["p_assigned", "p_last"]
            )

    held = matrix.filter(F.col("fold") >= 0)
    return held.mapInArrow(in_task, schema + ", p_assigned double, p_last double")
