"""Whitening of embeddings: principal components by matrix-free block subspace iteration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import written

#: Components that are returned, and columns that the iteration carries beyond them: more make it converge in fewer passes.
COMPONENTS, EXTRA = 16, 48
#: A component is certified when the norm of V q - e q is at most this share of the largest eigenvalue and no longer falls; PASSES bounds the passes.
CERTIFIED, PASSES = 1e-11, 500
#: Eigenvalues below this share of the trace are directions without spread, which cannot be whitened.
NO_SPREAD = 1e-12
#: Rows of a block that is held in doubles, and partial sums that the driver adds up.
BLOCK, PARTS = 1024, 64
#: Scale and offset of the integers, and the largest entry that they hold exactly.
SCALE, OFFSET, LARGEST = 64, 1_000_000, 1e12
SEED = 5


@dataclass
class Whitening:
    """``vectors`` (a column a component) and ``values`` of the covariance, the count and exact sums of the fit list, and what was measured."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    residual: float
    identity_error: float


def integers(rows: DataFrame, vector: str) -> DataFrame:
    """The rows of whole vectors with ``x``: floor(64 c) + 1000000 of each entry c, taken as double."""
    c = F.transform(vector, lambda v: v.cast("double"))
    sound = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(c, lambda v: v.isNotNull() & (F.abs(v) <= LARGEST))
    x = F.transform(c, lambda v: F.floor(v * SCALE) + OFFSET)
    return rows.where(F.coalesce(sound, F.lit(False))).withColumn("x", x)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of the batches, and their ``x`` as a matrix of integers."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            yield batch, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def exact_offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: in 64 bits where they suffice, else as Python's integers."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums), default=0)
    return x * np.int64(n) - np.array(sums, np.int64) if most < 1 << 62 else x.astype(object) * n - np.array(sums, object)


def deviations(offsets: np.ndarray) -> list[int]:
    """Sum of the squares of each row, exactly."""
    most = int(np.abs(offsets).max(initial=0))
    if most * most * offsets.shape[1] >= 1 << 63:
        offsets = offsets.astype(object)
    return [int(v) for v in (offsets * offsets).sum(1)]


def _summed(rows: DataFrame, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` over all blocks of ``x``: one matrix a task, added up in PARTS tasks, then in the driver, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in _blocks(batches):
            total += part(x)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["task", "sum"])

    def add(group: pa.Table) -> pa.Table:
        found = sorted(zip(group.column("task").to_pylist(), group.column("sum").to_pylist(), strict=True))
        total = np.sum([np.frombuffer(s).reshape(shape) for _, s in found], 0)
        return pa.table([pa.array([found[0][0] % PARTS], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["task", "sum"])

    parts = rows.select("x").mapInArrow(run, "task long, sum binary")
    parts = parts.groupBy(F.col("task") % PARTS).applyInArrow(add, "task long, sum binary")
    return np.sum([np.frombuffer(r["sum"]).reshape(shape) for r in sorted(parts.collect())] or [np.zeros(shape)], 0)


def subspace(multiply: Callable[[np.ndarray], np.ndarray], d: int, components: int, extra: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Unit eigenvectors, eigenvalues, passes and largest residual of a symmetric matrix that is only known by its products.

    A pass multiplies a block of orthonormal columns. The Rayleigh-Ritz step
    solves the small problem in the block's span; the residuals V q - e q of
    the Ritz vectors follow from the same product. While they are too large
    the product, orthonormalised by QR, is the next block. Once they are small
    the passes go on as long as residuals fall, down to what doubles can hold.
    """
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, min(d, components + extra))))[0]
    k, best = min(d, components), None
    for passes in range(1, PASSES + 1):
        product = multiply(block)
        small = block.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, product = block @ turn, product @ turn
        residual = np.linalg.norm(product - vectors * values, axis=0)[:k].max(initial=0.0)
        largest = max(values[0], 0.0)
        fell = best is None or residual < best[3] / 2
        if best is None or residual < best[3]:
            best = (vectors[:, :k], values[:k], passes, residual)
        if largest <= 0 or best[3] <= CERTIFIED * largest and not (fell and residual > 1e-15 * largest):
            break
        block = np.linalg.qr(product)[0]
    return best[0], best[1], passes, best[3]


def fit(rows: DataFrame, components: int = COMPONENTS, extra: int = EXTRA) -> Whitening | None:
    """The components of the distinct ``x`` of the rows; None without rows. See ``whiten``."""
    distinct = written(rows.select("x").distinct(), "whitening-fit")
    sizes = distinct.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()
    n, d = sizes[0], sizes[2]
    if not n:
        return None
    if sizes[1] != d:
        raise ValueError(f"vectors have {sizes[1]} to {d} entries")
    sums = [0] * d
    total = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    for r in total.collect():
        sums[r["i"]] = int(r["s"])

    def centred(x: np.ndarray) -> np.ndarray:
        return exact_offsets(x, n, sums).astype(np.float64) / n

    def multiply(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ block)

        return _summed(distinct, block.shape, part) / n

    def spread(x: np.ndarray) -> np.ndarray:
        c = centred(x)
        return np.array([[(c * c).sum()]])

    trace = float(_summed(distinct, (1, 1), spread)[0, 0]) / n
    vectors, values, passes, residual = subspace(multiply, d, components, extra)
    spreads = values > NO_SPREAD * max(trace, 0.0)
    vectors, values = vectors[:, spreads], values[spreads]
    k = len(values)
    if not k:
        return Whitening(n, sums, vectors, values, trace, passes, residual, 0.0)
    project = vectors / np.sqrt(values)
    mean = _summed(distinct, (1, k), lambda x: (centred(x) @ project).sum(0)[None]) / n

    def outer(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ project - mean
        return w.T @ w

    error = float(np.abs(_summed(distinct, (k, k), outer) / n - np.eye(k)).max())
    return Whitening(n, sums, vectors, values, trace, passes, residual, error)


def whiten(rows: DataFrame, *, vector: str = "embedding", keep: list[str] | None = None, components: int = COMPONENTS, extra: int = EXTRA) -> DataFrame:
    """Rows of whole vectors, once for each component, with their whitened value.

    New columns: ``component`` from 1 by falling variance, ``n`` distinct
    integer vectors, ``deviation`` of the row from their mean (exact; null
    beyond 64 bits), ``whitened``, ``explained`` share of the variance and
    ``identity_error``, the largest entry by which the covariance of the
    whitened fit list differs from the identity. Other columns, or those of
    ``keep``, stay; clashing ones are replaced.

    Entries become the integers floor(64 c) + 1000000, so that sums are exact
    and do not depend on the order of rows. Every distinct vector counts once,
    however many copies there are. The covariance matrix V is never formed:
    each pass of the iteration is one Spark job that computes X'(XQ) over the
    centred rows, a d x p matrix a task, and QR and Rayleigh-Ritz work on d x p
    matrices in the driver, until the residuals certify all components. With
    p = components + extra columns the error falls by the ratio of eigenvalue
    p + 1 to the last component's each pass; where p reaches the dimension the
    block spans everything and the second pass only certifies.

    Rows whose vector is null, empty, or holds null, a value that is not
    finite, or one beyond 1e12 go. Vectors of different lengths are an error.
    Repeated rows stay and get the same values; null ids stay. Fewer components
    come back where the vectors spread in fewer directions; one distinct vector
    alone has none, so its rows yield nothing. An empty table gives an empty
    result.
    """
    made = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [c.split()[0] for c in made.split(", ")]
    kept = [c for c in (rows.columns if keep is None else keep) if c not in names and c != "x"]
    rows = integers(rows.drop("x"), vector)
    model = fit(rows, components, extra)
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), made])
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    k, project = len(model.values), model.vectors / np.sqrt(model.values)
    explained = model.values / model.trace if model.trace else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches):
            size = batch.num_rows
            offsets = exact_offsets(x, model.n, model.sums)
            whitened = (offsets.astype(np.float64) / model.n) @ project
            exact = [v if v < 1 << 63 else None for v in deviations(offsets)]
            each = pa.array(np.repeat(np.arange(size), k))
            columns = [batch.column(c).take(each) for c in kept]
            columns += [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, model.n))]
            columns += [pa.array(exact, pa.int64()).take(each), pa.array(whitened.ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * k, model.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return rows.select(*kept, "x").mapInArrow(run, schema)
