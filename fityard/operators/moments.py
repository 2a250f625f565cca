"""Means, moments and matrix products of wide rows, and the leading eigenvectors that follow from them.

Rows are plain columns or one vector column. Every task works on whole batches and gives one result; results are cut into
stripes of rows, which Spark adds up by stripe, so that no task and no query row holds the results of all tasks. A missing
value (null or NaN) counts as the mean of its column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fityard.functions.vectors import quoted

STRIPE_CELLS = 1 << 16  # numbers in one stripe, about
EXTRA = -1              # stripe of the numbers that belong to all rows together


def arrays(df: DataFrame, features: str | Sequence[str], *others: str) -> DataFrame:
    """``(x, *others)``: features as an array of doubles, from a vector column or from plain columns."""
    x = (vector_to_array(features) if isinstance(features, str)
         else F.array(*[quoted(c).cast("double") for c in features]))
    return df.select(x.alias("x"), *others)


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """A batch of arrays as a matrix, nulls as NaN; a row that is null as a whole is all NaN."""
    if column.null_count:
        column = column.fill_null(pa.scalar([None] * width, column.type))
    flat = column.flatten().fill_null(float("nan")) if column.flatten().null_count else column.flatten()
    return np.asarray(flat, dtype=float).reshape(-1, width)


def width_of(x: DataFrame) -> int:
    first = x.filter("x is not null").select(F.size("x")).first()
    if first is None:
        raise ValueError("there are no rows")
    return first[0]


def _stripes(matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    rows = max(1, STRIPE_CELLS // max(matrix.shape[1], 1))
    for s in range(0, matrix.shape[0], rows):
        yield s, matrix[s:s + rows]


def summed(x: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``(stripe, sums)``: ``work`` turns the batches of a task into a matrix and a list of further numbers; both are added
    up over all tasks. A stripe is named by its first row."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, more = work(batches)
        found = [*_stripes(matrix), (EXTRA, np.asarray(more, dtype=float))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in found], pa.int32()),
             pa.array([m.reshape(-1).tolist() for _, m in found], pa.list_(pa.float64()))], names=["stripe", "sums"])

    parts = x.mapInArrow(part, "stripe int, sums array<double>")
    return parts.groupBy("stripe").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))


def collected(stripes: DataFrame, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The matrix and the further numbers of :func:`summed`; nothing but those reaches the driver."""
    matrix, more = np.zeros(shape), np.zeros(0)
    for row in stripes.collect():
        values = row["sums"].toArray()
        if row["stripe"] == EXTRA:
            more = values
        else:
            block = values.reshape(-1, shape[1])
            matrix[row["stripe"]:row["stripe"] + len(block)] = block
    return matrix, more


def column_means(x: DataFrame, width: int | None = None) -> tuple[int, np.ndarray]:
    """Number of rows, and the mean of the present values of every column; a column without any is an error."""
    width = width or width_of(x)

    def work(batches):
        sums, n = np.zeros((width, 2)), 0
        for batch in batches:
            m = rows_of(batch.column(0), width)
            sums += np.stack([np.nansum(m, axis=0), (~np.isnan(m)).sum(axis=0)], axis=1)
            n += len(m)
        return sums, [n]

    sums, n = collected(summed(x.select("x"), work), (width, 2))
    if not n.size or not n[0]:
        raise ValueError("there are no rows")
    if (sums[:, 1] == 0).any():
        raise ValueError(f"column {int(np.argmin(sums[:, 1]))} has no value at all")
    return int(n[0]), sums[:, 0] / sums[:, 1]


def _filled(m: np.ndarray, mean: np.ndarray, origin: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(m), mean, m) - origin


def scatter(x: DataFrame, mean: np.ndarray, centered: bool = True) -> DataFrame:
    """``(stripe, sums)`` of ``sum(x_i * x_j)`` over imputed rows, around the mean or around zero."""
    origin = mean if centered else np.zeros_like(mean)

    def work(batches):
        out = np.zeros((len(mean), len(mean)))
        for batch in batches:
            m = _filled(rows_of(batch.column(0), len(mean)), mean, origin)
            out += m.T @ m
        return out, [0.0]

    return summed(x.select("x"), work)


def matrix_rows(stripes: DataFrame, width: int, out: str, factor: float = 1.0) -> DataFrame:
    """``(i, j, out)`` from stripes of a matrix with ``width`` columns; no number passes through the driver."""
    cells = stripes.filter(F.col("stripe") != EXTRA).select("stripe", F.posexplode(vector_to_array("sums")).alias("at", "v"))
    return cells.select((F.col("stripe") + F.expr(f"cast(at div {width} as int)")).alias("i"), (F.col("at") % width).alias("j"),
                        (F.col("v") * F.lit(factor)).alias(out))


def product(x: DataFrame, mean: np.ndarray, centered: bool) -> Callable[[np.ndarray], tuple[np.ndarray, float]]:
    """Function that multiplies the scatter matrix by given columns, one pass over the rows without the matrix
    itself, and tells its trace."""
    origin, spark = mean if centered else np.zeros_like(mean), x.sparkSession

    def times(columns: np.ndarray) -> tuple[np.ndarray, float]:
        sent = spark.sparkContext.broadcast((mean, origin, columns))

        def work(batches):
            mean_, origin_, q = sent.value
            out, trace = np.zeros(q.shape), 0.0
            for batch in batches:
                m = _filled(rows_of(batch.column(0), len(mean_)), mean_, origin_)
                out += m.T @ (m @ q)
                trace += float(np.square(m).sum())
            return out, [trace]

        image, trace = collected(summed(x.select("x"), work), columns.shape)
        sent.destroy()
        return image, float(trace[0])

    return times


def _orthonormal(columns: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(columns, axis=0)
    q, r = np.linalg.qr(columns[:, size > 0] / size[size > 0])
    return q[:, np.abs(np.diag(r)) > 1e-10]


def leading_components(times: Callable[[np.ndarray], tuple[np.ndarray, float]], width: int, k: int, tol: float = 1e-11,
                       max_passes: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Leading ``k`` eigenvectors (columns) and eigenvalues of a symmetric matrix, and its trace.

    ``times`` multiplies the matrix by columns. Block subspace iteration: a pass multiplies the current vectors, what they
    miss (residuals) and the last step, and takes the best vectors out of the space that those span. It ends
    when all residuals are at most ``tol`` of the trace; not getting there in ``max_passes`` is an error.
    """
    if not 1 <= k <= width:
        raise ValueError(f"k must lie between 1 and {width}")
    block = min(width, k + min(k, 8) + 2)
    basis = np.random.default_rng(0).normal(size=(width, block))
    for _ in range(max_passes):
        basis = np.eye(width) if basis.shape[1] >= width else _orthonormal(basis)
        image, trace = times(basis)
        if not np.isfinite(image).all():
            raise ValueError("the moments aren't finite")
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:block], turn[:, ::-1][:, :block]
        vectors, images = basis @ turn, image @ turn
        residual = images - vectors * values
        if np.linalg.norm(residual[:, :k], axis=0).max() <= tol * max(trace, 1e-300) or basis.shape[1] == width:
            return vectors[:, :k], values[:k], trace
        # What of the new vectors lies outside of the old ones.
        step = basis[:, block:] @ turn[block:] if basis.shape[1] > block else residual[:, :0]
        basis = np.hstack([vectors, residual, step])
    raise ValueError(f"the components have not converged after {max_passes} passes")
