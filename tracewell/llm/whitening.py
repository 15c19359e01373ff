"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Rows lie in blocks, spread over the tasks. The driver holds only what is as long as a vector: a step sends two products'
factors to the blocks and gets sums over all rows back, added by Spark per dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Bytes of a block of rows at 8 bytes an entry.
BLOCK_BYTES = 8 << 20
#: What counts as nothing beside the largest singular value.
NOTHING = 1e-10


@dataclass(frozen=True)
class Whitening:
    """The fit: n different rows with sums per dimension; components (one per column) and eigenvalues of their
    covariance, its trace, the number of steps and the largest entry by which whitened rows miss the identity."""

    scale: int
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * entry) of vectors whose entries are all finite."""
    e = F.col("embedding").cast("array<double>")
    usable = (F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(usable, F.lit(False))).select("vec_id", F.transform(e, lambda c: F.floor(c * scale)).alias("x"))


def _rows(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length, as a matrix."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _blocks(x: DataFrame, dims: int) -> DataFrame:
    """(rows, kind, data): the rows of x in blocks, in the smallest kind of integer that holds them."""
    most = max(1, BLOCK_BYTES // (8 * dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def block(rows: np.ndarray) -> pa.RecordBatch:
            kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= rows.min() and rows.max() <= np.iinfo(k).max)
            return pa.RecordBatch.from_arrays([pa.array([len(rows)]), pa.array([kind]), pa.array([rows.astype(kind).tobytes()], pa.binary())], names=["rows", "kind", "data"])

        for batch in batches:
            held.append(_rows(batch.column("x")))
            if sum(map(len, held)) >= most:
                rows = np.concatenate(held)
                held = [rows[len(rows) // most * most :]]
                yield from (block(rows[i : i + most]) for i in range(0, len(rows) // most * most, most))
        if sum(map(len, held)):
            yield block(np.concatenate(held))

    return x.select("x").mapInArrow(run, "rows long, kind string, data binary")


def _each_block(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
            yield np.frombuffer(data.as_buffer(), kind).reshape(-1, dims)


def _sums(blocks: DataFrame, dims: int) -> tuple[int, ...]:
    """Exact sums per dimension, however large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for x in _each_block(batches, dims):
            small = int(np.abs(x.astype(float)).max()) < (1 << 61) // len(x)
            total = [t + int(s) for t, s in zip(total, x.sum(axis=0, dtype=np.int64 if small else object), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["at", "s"])

    rows = blocks.mapInArrow(run, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).collect()
    return tuple(int(r["s"]) for r in sorted(rows, key=lambda r: r["at"]))


def _summed(blocks: DataFrame, dims: int, mean: np.ndarray, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of of(centred rows), a vector whose length does not depend on the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _each_block(batches, dims):
            part = of(x - mean)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["at", "s"])

    rows = blocks.mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    return np.array([r["s"] for r in sorted(rows, key=lambda r: r["at"])])


class _Bidiagonal:
    """U' X V = B, column by column: V (right) and B are whole on the driver, a column of U lives as the vector w with
    u = X w, so that each task makes its own rows of U again and no row vector is ever stored."""

    def __init__(self, blocks: DataFrame, dims: int, mean: np.ndarray):
        self.blocks, self.dims, self.mean = blocks, dims, mean
        self.right, self.weights, self.images = (np.zeros((dims, 0)) for _ in range(3))
        self.b = np.zeros((0, 0))
        self.square, self.beta = 0.0, 0.0
        self.random = np.random.default_rng(7)

    def products(self, q: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """U'p, p'p and X'p of p = X q: both products of a step in one pass over the rows."""
        both = np.column_stack([self.weights, q])
        k, first = both.shape[1], not self.square

        def of(x: np.ndarray) -> np.ndarray:
            y = x @ both
            p = y[:, -1]
            return np.concatenate([p @ y, p @ x, [np.einsum("ij,ij->", x, x) if first else 0.0]])

        out = _summed(self.blocks, self.dims, self.mean, of)
        self.square = self.square or float(out[-1])
        return out[: k - 1], float(out[k - 1]), out[k : k + self.dims]

    def fresh(self, v: np.ndarray) -> tuple[np.ndarray, float]:
        """v without its part along the right vectors, twice, and the length of what is left."""
        for _ in range(2):
            v = v - self.right @ (self.right.T @ v)
        return v, float(np.linalg.norm(v))

    def start(self) -> np.ndarray:
        self.beta = 0.0
        v, size = self.fresh(self.random.standard_normal(self.dims))
        return v / size

    def step(self, v: np.ndarray) -> np.ndarray | None:
        """Take in v: its column of B, its left vector, and the next right vector (None where the space is closed)."""
        rows, cols = self.b.shape
        column = np.zeros(rows)
        q = v
        if self.beta:  # known from the step before
            column[-1] = self.beta
            q = v - self.beta * self.weights[:, -1]
        for _ in range(3):  # against all left vectors, again while a part of them is left
            along, size, image = self.products(q)
            column += along
            q = q - self.weights @ along
            image = image - self.images @ along
            size = max(size - float(along @ along), 0.0)
            if float(along @ along) <= 1e-6 * size:
                break
        self.right = np.column_stack([self.right, v])
        self.b = np.column_stack([self.b, column])
        scale = max(np.sqrt(size), float(np.linalg.norm(self.b, 2)) if self.b.size else 0.0)
        alpha = np.sqrt(size)
        if alpha <= NOTHING * scale or not scale:
            return None
        self.weights = np.column_stack([self.weights, q / alpha])
        self.images = np.column_stack([self.images, image / alpha])
        self.b = np.vstack([self.b, np.zeros((1, cols + 1))])
        self.b[-1, -1] = alpha
        after, beta = self.fresh(image / alpha)
        self.beta = beta
        return after / beta if beta > NOTHING * scale else None

    def settled(self, wanted: int) -> bool:
        """The wanted singular vectors will not change by more steps: residual over the gap to their neighbours."""
        left, sigma, _ = np.linalg.svd(self.b)
        if len(sigma) <= wanted or self.b.shape[0] != self.b.shape[1]:
            return False
        gaps = sigma[:wanted] - sigma[1 : wanted + 1]
        gaps = np.minimum(gaps, np.concatenate([[np.inf], gaps[:-1]]))
        return bool((self.beta * np.abs(left[-1, :wanted]) <= 1e-14 * np.maximum(gaps, 1e-12 * sigma[0])).all())


def fit_whitening(x: DataFrame, components: int = 4, scale: int = 256, least_steps: int = 64) -> Whitening | None:
    """Fit on the different rows of x (array<long>), each counted once; None without any.

    Bidiagonalisation takes in one right vector a step, orthogonal to all before, until the wanted components are settled
    (and least_steps are done: of vectors no longer than that the factorisation is whole, equal eigenvalues too). Where a
    Krylov space closes early, a new random direction goes on. There are as many components as the covariance has
    eigenvalues above 1e-18 of its largest.
    """
    one = x.select(F.size("x").alias("d")).limit(1).collect()
    if not one:
        return None
    dims = one[0]["d"]
    blocks = materialise(_blocks(x.select("x").distinct(), dims))
    n = blocks.agg(F.sum("rows")).collect()[0][0]
    sums = _sums(blocks, dims)
    fit = _Bidiagonal(blocks, dims, np.array([s / n for s in sums]))
    v: np.ndarray | None = fit.start()
    for step in range(1, dims + 1):
        v = fit.step(v)
        if not fit.square or step == dims or (step >= least_steps and v is not None and fit.settled(components)):
            break
        v = fit.start() if v is None else v
    if not fit.square:  # one row, or none but equal ones
        return Whitening(scale, n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0, 0.0, step)
    _, sigma, turned = np.linalg.svd(fit.b)
    sigma = sigma[: min(components, int((sigma > 1e-9 * sigma[0]).sum()))]
    found = fit.right @ turned[: len(sigma)].T
    found /= np.linalg.norm(found, axis=0)
    k = len(sigma)

    def of(rows: np.ndarray) -> np.ndarray:
        y = rows @ found
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

    out = _summed(blocks, dims, fit.mean, of) / n
    products, means = out[: k * k].reshape(k, k), out[k * k :]
    covariance = products - np.outer(means, means)
    values = np.diag(covariance).copy()
    error = np.abs(covariance / np.sqrt(np.outer(values, values)) - np.eye(k)).max()
    return Whitening(scale, n, sums, found, values, fit.square / n, float(error), step)


def whitened(x: DataFrame, fit: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each row of x and component;
    deviation is exact, null where it is no long."""
    mean, total = fit.mean, max(map(abs, fit.sums))
    k = len(fit.values)
    turn = fit.components / np.sqrt(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(fit.sums, object)
        for batch in batches:
            if not len(batch):
                continue
            rows = _rows(batch.column("x"))
            bound = fit.n * max(abs(int(rows.min())), abs(int(rows.max()))) + total
            if bound * bound * rows.shape[1] < 1 << 63:
                deviation = ((fit.n * rows - sums.astype(np.int64)) ** 2).sum(axis=1)
            else:
                exact = ((fit.n * rows.astype(object) - sums) ** 2).sum(axis=1)
                deviation = [d if d < 1 << 63 else None for d in exact]
            of = pa.array(np.repeat(np.arange(len(rows)), k))
            m = len(of)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(of), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()), pa.array(np.full(m, fit.n)), pa.array(deviation, pa.int64()).take(of),
                    pa.array(((rows - mean) @ turn).ravel()), pa.array(np.tile(fit.values / fit.trace, len(rows)) if k else np.zeros(0)), pa.array(np.full(m, fit.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.select("vec_id", "x").mapInArrow(run, f"vec_id {x.schema['vec_id'].dataType.simpleString()}, {_SCHEMA}")


_SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def of_one_length(x: DataFrame) -> DataFrame:
    """The rows of the commonest length, the longest of equally common ones: others have no place in one space."""
    length: Column = F.size("x")
    lengths = x.groupBy(length.alias("d")).agg(F.count("*").alias("n"))
    d = lengths.agg(F.max_by("d", F.struct("n", "d"))).collect()[0][0]
    return x.where(length == F.lit(d))


def whiten_vectors(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """whitened() of vectors (vec_id, embedding) by a fit on the same table.

    Vectors that are null, empty, or hold null or non-finite entries are left out, as are those whose length is not the
    commonest. Repeated vectors count once in the fit and have rows each; null and repeated ids stay as they are; no
    rows come from an empty table or from vectors that are all equal. Entries too large for a long become the nearest.
    """
    x = of_one_length(integer_vectors(vectors, scale))
    fit = fit_whitening(x, components, scale)
    if fit is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, {_SCHEMA}")
    return whitened(x, fit)
