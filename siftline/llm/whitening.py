"""Embedding whitening by matrix-free block Lanczos.

The covariance V is never formed. A pass over the vectors multiplies a block of vectors v:
each task centres its rows, takes the products with the block and sends back X'(X v) of its
rows; the sums of all tasks are V v. Blocks are orthogonalised in full against all earlier
ones, twice; a block that loses rank (an invariant subspace) goes on with random vectors
orthogonal to the basis. Ritz pairs come from the basis and its products, which are kept, so
that residuals are those of V itself. When all wanted ones have converged a random block is
added once more: an eigenvalue that the first block couldn't see shows there. A basis that
has grown to MOST_BASIS vectors is restarted from its leading Ritz vectors.

The trace of V comes from the exact deviations of the rows, so shares don't wait for the
other eigenvalues. Driver memory is that of the basis: dimensions x MOST_BASIS.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

COMPONENTS = 32
BLOCK = 16
MOST_BASIS = 512
#: Residuals, over the largest eigenvalue, under which a Ritz pair has converged.
TOLERANCE = 1e-13
#: Eigenvalues under this share of the largest are zero: the vectors don't vary there.
NO_VARIANCE = 1e-12
MAX_PASSES = 1000
SEED = 42

#: The fixed-point form of an entry c: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Larger numbers than this one have no exact fixed-point form; they count as not finite.
LARGEST = float(1 << 40)


def _matrix(batch: pa.RecordBatch, column: int, dims: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of clean vectors (or the one asked for) the places of the rows in the batch and floor(SCALE * c), a row for each."""
    lists = batch.column(column)
    sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for d in np.unique(sizes[sizes > 0]) if dims is None else [dims]:
        rows = np.flatnonzero(sizes == d)
        if not len(rows):
            continue
        c = flat[(ends[rows] - d)[:, None] + np.arange(d)[None, :]]
        good = (np.abs(c) < LARGEST).all(axis=1)  # false for what isn't a number, as nulls are here
        if good.any():
            yield rows[good], np.floor(c[good] * SCALE).astype(np.int64)


_SUMS = T.StructType([T.StructField("d", T.IntegerType()), T.StructField("i", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", T.LongType())])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for batch in batches:
        for _, x in _matrix(batch, 0):
            n, s = held.get(x.shape[1], (0, 0))
            held[x.shape[1]] = [n + len(x), s + x.sum(axis=0)]
    for d, (n, s) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(s)], _SUMS.names)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """The sum over the dimensions of (n * x - S)^2 of each row, exact at any size."""
    most = float(n) * float(np.abs(x).max(initial=0)) + float(np.abs(sums).max(initial=0))
    if most < 1 << 62 and x.shape[1] * most * most < 1 << 62:
        return (((n * x - sums) ** 2).sum(axis=1)).tolist()
    off = n * x.astype(object) - sums.astype(object)
    return (off * off).sum(axis=1).tolist()


_CELLS = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("v", T.DoubleType())])
_TRACE = T.StructType([T.StructField("t", T.StringType())])


def _cells(m: np.ndarray) -> pa.RecordBatch:
    i, j = np.indices(m.shape, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(m.ravel())], _CELLS.names)


def _products(batches: Iterator[pa.RecordBatch], mean: np.ndarray, block: np.ndarray) -> Iterator[pa.RecordBatch]:
    """X'(X v) of a task's centred rows."""
    total, seen = np.zeros_like(block), False
    for batch in batches:
        for _, x in _matrix(batch, 0, len(mean)):
            centred, seen = x - mean, True
            total += centred.T @ (centred @ block)
    if seen:
        yield _cells(total)


def _moments(batches: Iterator[pa.RecordBatch], mean: np.ndarray, to: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of a task's whitened rows (row 0) and of their products."""
    k = to.shape[1]
    total, seen = np.zeros((k + 1, k)), False
    for batch in batches:
        for _, x in _matrix(batch, 0, len(mean)):
            w, seen = (x - mean) @ to, True
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
    if seen:
        yield _cells(total)


def _traces(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        for _, x in _matrix(batch, 0, len(sums)):
            total += sum(deviations(x, n, sums))
    yield pa.RecordBatch.from_arrays([pa.array([str(total)])], _TRACE.names)


def _summed(rows: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the tasks' matrices: cells are added up on the executors, the driver gets one for each place."""
    out = np.zeros(shape)
    for r in rows.groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["i"], r["j"]] = r["v"]
    return out


def _orthonormal(block: np.ndarray, basis: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """An orthonormal block, orthogonal to the basis, for the span of `block`; lost directions become random ones."""
    room = basis.shape[0] - basis.shape[1]
    out = basis
    for v in block.T[:room]:
        for _ in range(50):
            size = np.linalg.norm(v)
            if size > 0:
                w = v / size
                w = w - out @ (out.T @ w)
                left = np.linalg.norm(w)
                if left > 1e-10:
                    w = w / left
                    w = w - out @ (out.T @ w)
                    out = np.column_stack([out, w / np.linalg.norm(w)])
                    break
            v = random.standard_normal(len(v))  # breakdown: restart with a random direction
    return out[:, basis.shape[1] :]


def block_lanczos(multiply: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, most_basis: int = MOST_BASIS) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors of a symmetric positive d x d matrix that is known by its products only."""
    random = np.random.default_rng(SEED)
    k, most_basis = min(k, d), max(most_basis, 2 * (k + block))
    basis, products = np.empty((d, 0)), np.empty((d, 0))
    new, checked = _orthonormal(random.standard_normal((d, min(block, d))), basis, random), None
    for _ in range(MAX_PASSES):
        basis, products = np.column_stack([basis, new]), np.column_stack([products, multiply(new)])
        small = basis.T @ products
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        vectors, images = basis @ turns, products @ turns
        residuals = images - vectors * values
        wanted = np.linalg.norm(residuals[:, :k], axis=0)
        if basis.shape[1] == d:
            break
        if basis.shape[1] >= k and (wanted <= TOLERANCE * max(values[0], 0)).all():
            if checked is not None and np.allclose(checked, values[:k], rtol=1e-12, atol=TOLERANCE * max(values[0], 0)):
                break
            checked, follow = values[:k], random.standard_normal((d, block))
        else:
            checked = None
            worst = np.argsort(-wanted, kind="stable")[:block]
            follow = residuals[:, worst] if basis.shape[1] >= k else residuals[:, -block:]
        if basis.shape[1] + block > most_basis:
            basis, products = vectors[:, : k + block], images[:, : k + block]
        new = _orthonormal(follow, basis, random)
    else:
        raise RuntimeError("block Lanczos did not converge")
    vectors = vectors[:, :k]
    return values[:k], vectors / np.linalg.norm(vectors, axis=0)


_WHITENED = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()),
    ]
)


def _whitened(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, mean: np.ndarray, to: np.ndarray, explained: np.ndarray, error: float) -> Iterator[pa.RecordBatch]:
    k = to.shape[1]
    for batch in batches:
        for rows, x in _matrix(batch, 1, len(sums)):
            off = [v if v < 1 << 63 else None for v in deviations(x, n, sums)]
            m = len(rows)
            ids = batch.column(0).take(pa.array(rows))
            columns = [
                ids.take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)),
                pa.array(off, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(((x - mean) @ to).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, _WHITENED.names)


def whiten(table: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """One row per remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Input: vec_id, embedding (other columns are ignored). A vector that is null or empty, or
    holds a null, an entry that is not finite or one over 2^40 in size is dropped; of the others those of the
    most frequent length stay (ties: the longest), so that all have the same dimensions.
    Repeated rows and null vec_ids keep their rows. Components without variance (under
    NO_VARIANCE of the largest) can't be whitened and have no rows; nor has a table without
    a remaining vector or with equal vectors only. A deviation beyond a long is null (the trace is exact still).
    """
    spark = table.sparkSession
    shared.ship(spark)
    rows = shared.pick(table, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    nothing = spark.createDataFrame([], _WHITENED)
    per = shared.materialise(rows.select("embedding").mapInArrow(_sums, _SUMS).groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "vector-sums")
    top = per.where("i = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return nothing
    d, n = top["d"], top["n"]
    sums = np.zeros(d, np.int64)
    for r in per.where(F.col("d") == d).toLocalIterator():
        sums[r["i"]] = r["s"]
    # x without its shift: centred values and deviations are the same.
    mean = sums / n
    vectors = rows.select("embedding")
    traced = vectors.mapInArrow(partial(_traces, n=n, sums=sums), _TRACE).agg(F.sum(F.col("t").cast("decimal(38,0)")).alias("t")).first()["t"]
    trace = int(traced) / n / n / n

    def multiply(v: np.ndarray) -> np.ndarray:
        return _summed(vectors.mapInArrow(partial(_products, mean=mean, block=v), _CELLS), v.shape) / n

    if trace == 0:
        return nothing
    values, basis = block_lanczos(multiply, d, components, block)
    k = int((values > NO_VARIANCE * values[0]).sum())
    values, to = values[:k], basis[:, :k] / np.sqrt(values[:k])
    moments = _summed(vectors.mapInArrow(partial(_moments, mean=mean, to=to), _CELLS), (k + 1, k)) / n
    error = float(np.abs(moments[1:] - np.outer(moments[0], moments[0]) - np.eye(k)).max())
    f = partial(_whitened, n=n, sums=sums, mean=mean, to=to, explained=values / trace, error=error)
    return rows.mapInArrow(f, _WHITENED)
