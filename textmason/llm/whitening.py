"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

A block of ``k + GUARD`` vectors is refined until its ``k`` leading ones are certified. One pass
over the data multiplies the block by the centred XᵀX/n. A polynomial of such passes, built by
Chebyshev's three-term recurrence, is small on the interval that holds the unwanted spectrum and
large above it; QR and a Rayleigh-Ritz step then order the block. The interval ends above at the
block's least Ritz value and starts at the least one ever seen, so that it widens by itself where
smaller eigenvalues show. No covariance matrix of all dimensions is formed, unless the block is
as wide as the vectors. What passes through the driver are blocks (dimensions x a few numbers).

The fit list, each distinct vector once, is stored in packed pieces that every pass reads.

Defined cases: rows with a null vector, or null or non-finite entries, are dropped; a vector
shorter than the longest counts as zero in the dimensions it lacks; entries beyond 2^53 / 256
saturate. Rows that repeat, also by id, each get their own result. With fewer dimensions than
components there are as many components as dimensions. A component without variance (all vectors
equal, or of fewer independent ones) has whitened 0 and explained 0, and ``identity_error``
leaves it out. Of equal eigenvalues any basis may come. A deviation beyond a long is null. An empty table gives an empty
result; other columns are ignored; very long vectors only cost their size, in pieces of
``PIECE_ENTRIES`` entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmason.llm.common import add_arrays, bound_batches, tidy
from textmason.session import cut_lineage, forget

COMPONENTS, GUARD = 4, 12
STEP = 256
#: Degree of the filter, and after how many filters without a result the block is doubled.
DEGREE, PATIENCE = 10, 8
#: Entries of a stored piece of the fit list.
PIECE_ENTRIES = 1 << 18
_MOST = 1 << 53
_EPS = np.finfo(float).eps
_PARTIAL = "part BIGINT, data BINARY"


def _usable(vector: Column) -> Column:
    def bad(c: Column) -> Column:
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))

    return vector.isNotNull() & ~F.exists(vector, bad)


def _integers(vector: Column) -> Column:
    """Entries in steps of 1/256, rounded down."""
    most = float(_MOST)
    scaled = F.transform(vector, lambda c: F.floor(F.least(
        F.greatest(c.cast("double") * STEP, F.lit(-most)), F.lit(most))))
    return F.transform(scaled, lambda c: c.cast("bigint"))


def integer_vectors(rows: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """((vec_id, x) of the usable rows, number of dimensions)."""
    bound_batches(rows.sparkSession)
    vector = rows[vector_column]
    kept = rows.filter(_usable(vector)).select(
        rows[id_column].cast("bigint").alias("vec_id"), _integers(vector).alias("x")
    )
    width, least = kept.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    if width and least < width:
        zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("x"))
        kept = kept.withColumn("x", F.concat("x", zeros))
    return kept, width or 0


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _packed(width: int):
    """Rows of x packed into pieces, in the narrowest integers that hold them."""
    most = max(1, PIECE_ENTRIES // width)

    def piece(rows: list[np.ndarray]):
        x = np.concatenate(rows)
        top = int(np.abs(x).max(initial=0))
        kind = next(k for k, end in (("i2", 2**15), ("i4", 2**31), ("i8", 2**63)) if top < end)
        return pa.RecordBatch.from_arrays(
            [pa.array([kind]), pa.array([np.ascontiguousarray(x, f"<{kind}").tobytes()], pa.binary())],
            names=["kind", "data"],
        )

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for start in range(0, len(x), most):
                rows.append(x[start : start + most].copy())
                held += len(rows[-1])
                if held >= most:
                    yield piece(rows)
                    rows, held = [], 0
        if held:
            yield piece(rows)

    return run


def _pieces(batches, width: int):
    for batch in batches:
        for kind, data in zip(*(column.to_pylist() for column in batch.columns)):
            yield np.frombuffer(data, f"<{kind}").reshape(-1, width)


class _Fit:
    """The stored fit list, with its size, mean and trace."""

    def __init__(self, vectors: DataFrame, width: int):
        self.width = width
        self.pieces = cut_lineage(
            vectors.select("x").distinct().mapInArrow(tidy(_packed(width)), "kind STRING, data BINARY")
        )
        self.n, self.sums = self._sums()
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(width)

    def _sums(self) -> tuple[int, list[int]]:
        """Exact number of vectors and sums per dimension."""
        width = self.width

        def run(batches):
            for x in _pieces(batches, width):
                # the number of rows goes as one more dimension; a piece's sums fit into a long
                sums = [len(x), *x.sum(axis=0, dtype=np.int64).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(width + 1), pa.int32()), pa.array(sums, pa.int64())], names=["at", "value"]
                )

        summed = self.pieces.mapInArrow(run, "at INT, value BIGINT").groupBy("at").agg(
            F.sum(F.col("value").cast("decimal(38,0)")).alias("value")
        )
        found = {row.at: int(row.value) for row in summed.collect()}
        return found.get(0, 0), [found.get(k + 1, 0) for k in range(width)]

    def total(self, of_piece, size: int) -> np.ndarray:
        """Sum over all pieces of ``of_piece(centred rows)``, an array of ``size`` numbers."""
        width, mean = self.width, self.mean

        def run(batches):
            total = np.zeros(size)
            for x in _pieces(batches, width):
                total += of_piece(x - mean).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "data"]
            )

        partial = self.pieces.mapInArrow(tidy(run), _PARTIAL).withColumn("part", F.spark_partition_id())
        return add_arrays(partial.select("data", "part"), "f8", size)

    def times(self, block: np.ndarray) -> np.ndarray:
        """Covariance times a block of vectors: one pass."""
        done = self.total(lambda rows: rows.T @ (rows @ block), block.size)
        return done.reshape(block.shape) / self.n


def _ritz(block: np.ndarray, image: np.ndarray):
    """Ritz values by falling size, vectors and their images, of an orthonormal block."""
    small = block.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], block @ turn, image @ turn


def _certified(values, vectors, images, k: int, before: np.ndarray | None) -> tuple[bool, np.ndarray]:
    """Whether the leading ``k`` are exact to rounding, and their residuals.

    A residual over the gap to the nearest other value bounds the error of a vector; the residuals
    must be as small as rounding lets them be, or so small that they stop falling.
    """
    residuals = np.linalg.norm(images - vectors * values, axis=0)[:k]
    scale = max(values[0], np.finfo(float).tiny)
    if (residuals <= 16 * _EPS * scale).all():
        return True, residuals
    gaps = np.array([np.abs(np.delete(values, j) - values[j]).min(initial=scale) for j in range(k)])
    gaps[gaps <= 1e-12 * scale] = scale  # equal values: any basis of theirs will do
    stuck = before is not None and len(before) == k and (residuals >= before / 2).any()
    return bool(stuck and (residuals <= 1e-11 * np.maximum(gaps, 1e-3 * scale)).all()), residuals


def _filtered(fit: _Fit, vectors, images, values, low: float) -> np.ndarray:
    """Chebyshev polynomial of the covariance, times the block; small on [low, least Ritz value]."""
    high, top = values[-1], values[0]
    half, middle = (high - low) / 2, (high + low) / 2
    first = half / (top - middle)
    ratio = first
    now, then = (images - middle * vectors) * (first / half), vectors
    for _ in range(DEGREE - 1):
        following = 1 / (2 / first - ratio)
        image = fit.times(now)
        now, then = (
            (image - middle * now) * (2 * following / half) - then * (ratio * following), now
        )
        ratio = following
    return now


def leading_components(fit: _Fit, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the fit list's covariance, largest first."""
    width, random = fit.width, np.random.default_rng(0)
    m = min(width, k + GUARD)
    block, _ = np.linalg.qr(random.standard_normal((width, m)))
    low, before, tries = None, None, 0
    while True:
        values, vectors, images = _ritz(block, fit.times(block))
        done, before = _certified(values, vectors, images, k, before)
        # a block of all dimensions is exact, and one without spread has nothing to damp
        if done or m == width or values[0] <= 0:
            return np.maximum(values[:k], 0), vectors[:, :k]
        low = max(0.0, min(values[-1] if low is None else low, values[-1]))
        tries += 1
        if tries % PATIENCE == 0 or values[-1] >= values[0] * (1 - 1e-9) or values[-1] <= 0:
            more = random.standard_normal((width, min(width, 2 * m) - m))
            m = min(width, 2 * m)
            block, before = np.hstack([vectors, more]), None
        else:
            # the interval must not be empty; where all Ritz values are one, half of it is unwanted
            block = _filtered(fit, vectors, images, values, low if low < values[-1] else values[-1] / 2)
        block, _ = np.linalg.qr(block)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n x - S)^2."""
    most = max((n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)), 1)
    if most * most * max(1, len(sums)) < 2**63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1).tolist()
    return [int(d) if d < 2**63 else None for d in exact]


def whiten(
    rows: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of the usable rows."""
    schema = ("vec_id BIGINT, component INT, n BIGINT, deviation BIGINT, whitened DOUBLE, "
              "explained DOUBLE, identity_error DOUBLE")
    vectors, width = integer_vectors(rows, id_column, vector_column)
    if not width:
        return rows.sparkSession.createDataFrame([], schema)
    fit = _Fit(vectors, width)
    k = min(components, width)
    trace = float(fit.total(lambda x: np.array([(x * x).sum()]), 1)[0]) / fit.n
    values, axes = leading_components(fit, k)
    real = values > 64 * _EPS * trace
    scale = np.where(real, 1 / np.sqrt(np.where(real, values, 1)), 0.0)
    explained = (np.where(real, values, 0) / trace if trace > 0 else np.zeros(k)).tolist()

    def spread(x):
        w = (x @ axes) * scale
        return w.T @ w

    covariance = fit.total(spread, k * k).reshape(k, k) / fit.n
    off = np.abs(covariance - np.eye(k))[np.ix_(real, real)]
    error = float(off.max(initial=0))
    n, sums, mean = fit.n, fit.sums, fit.mean
    forget(fit.pieces)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), width)
            whitened = ((x - mean) @ axes) * scale
            found = _deviations(x, n, sums)
            size = len(x) * k
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(size, n)), pa.array([d for d in found for _ in range(k)], pa.int64()),
                 pa.array(whitened.reshape(-1)), pa.array(explained * len(x), pa.float64()),
                 pa.array(np.full(size, error))],
                names=[part.split()[0] for part in schema.split(", ")],
            )

    return vectors.mapInArrow(tidy(run), schema)
