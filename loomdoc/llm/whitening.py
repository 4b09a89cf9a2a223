"""Operator 13: whitening of embeddings from streamed moments.

Entries become x = floor(64 c) + 1000000. Each partition runs over its vectors once, by Welford's
rank-one update: the mean moves by a share of the difference, and the sum of squares gains the outer product of the
differences before and after. It hands on one summary (rows, exact sums, mean, squares), whatever its rows. Summaries merge by the
parallel update formula, first in about sqrt(partitions) groups on the executors, then those on the driver.

The covariance (divisor n) goes through Householder reflections to tridiagonal form and through
symmetric QR steps with Wilkinson's shift to eigenvalues and vectors; d x d numbers, whatever the rows. A second run of the
same moments over the whitened vectors measures their covariance's distance from the identity.

Dropped: null vectors, those with null or non-finite entries, those of another length than most (ties: the longer), and empty
ones. Repeated rows and copies count one by one; null vec_ids are ids as any other. A direction
without variance (eigenvalue below ``FLAT`` of the largest) can't be whitened: its ``whitened`` is null, and identity_error leaves it out.
One vector alone, or copies of one: all such. No vector left: no rows. Equal eigenvalues: any basis, the same for all rows.
Entries beyond 2**40 and deviations beyond 64 bits raise an error. Very long vectors: a summary holds d x d doubles. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from loomdoc.session import table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Larger entries would not be whole numbers of 64 bits after sums.
LARGEST = 2.0**40
#: Directions with less variance than this share of the largest have none, up to rounding.
FLAT = 1e-11


class Moments:
    """Rows, exact sums, mean, and the sum of outer products of differences from the mean."""

    def __init__(self, n: int, total: np.ndarray, mean: np.ndarray, squares: np.ndarray):
        self.n, self.total, self.mean, self.squares = n, total, mean, squares

    @classmethod
    def none(cls, d: int) -> Moments:
        return cls(0, np.zeros(d, object), np.zeros(d), np.zeros((d, d)))

    def add(self, x: np.ndarray) -> None:
        """One more vector: a rank-one update."""
        self.n += 1
        before = x - self.mean
        self.mean += before / self.n
        self.squares += np.outer(before, x - self.mean)

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        step = other.mean - self.mean
        squares = self.squares + other.squares + np.outer(step, step) * (self.n * other.n / n)
        return Moments(n, self.total + other.total, self.mean + step * (other.n / n), squares)

    def covariance(self) -> np.ndarray:
        return (self.squares + self.squares.T) / (2 * max(self.n, 1))


_SUMMARY = "n long, total array<string>, mean array<double>, squares array<double>"


def _row(m: Moments) -> pd.DataFrame:
    return pd.DataFrame({"n": [m.n], "total": [[str(t) for t in m.total]], "mean": [m.mean.tolist()], "squares": [m.squares.ravel().tolist()]})


def _merged(rows: pd.DataFrame) -> Moments | None:
    out = None
    for r in rows.sort_values("n", kind="stable").itertuples():
        d = len(r.mean)
        m = Moments(int(r.n), np.array([int(t) for t in r.total], object), np.asarray(r.mean, float), np.asarray(r.squares, float).reshape(d, d))
        out = m if out is None else out.merged(m)
    return out


def moments(rows: DataFrame, column: str, d: int, values: Callable[[np.ndarray], np.ndarray], exact: bool = True) -> Moments:
    """Of ``values`` (a matrix of vectors -> a matrix) over all vectors of length ``d`` in ``column``."""
    parts = max(1, rows.rdd.getNumPartitions())
    groups = max(1, math.isqrt(parts))

    def partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for batch in batches:
            if not len(batch):
                continue
            matrix = values(np.stack(batch[column].to_numpy()))
            out = out or Moments.none(matrix.shape[1])
            if exact:
                out.total = out.total + np.array([int(v) for v in matrix.astype(np.int64).sum(axis=0)], object)  # a batch's sum stays below 64 bits
            for x in matrix.astype(float):
                out.add(x)
        if out is not None:
            yield _row(out)

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _row(_merged(rows))

    summaries = rows.select(column).mapInPandas(partition, _SUMMARY)
    if groups > 1:
        summaries = summaries.withColumn("part", F.spark_partition_id() % groups).groupBy("part").applyInPandas(merge, _SUMMARY)
    return _merged(summaries.toPandas()) or Moments.none(d)  # at most about sqrt(partitions) rows


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal Q with a = Q T Q', by Householder reflections."""
    a, d = a.astype(float).copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0:
            continue
        v[0] += math.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by implicit QR steps with Wilkinson's shift."""
    diagonal, off, q = tridiagonal(a)
    columns = np.ascontiguousarray(q.T)  # row k is eigenvector k in the making
    high = len(diagonal) - 1
    small = np.finfo(float).eps
    for _ in range(60 * len(diagonal) + 60):
        while high > 0 and abs(off[high - 1]) <= small * (abs(diagonal[high - 1]) + abs(diagonal[high])):
            off[high - 1] = 0.0
            high -= 1
        if high <= 0:
            break
        low = high - 1
        while low > 0 and abs(off[low - 1]) > small * (abs(diagonal[low - 1]) + abs(diagonal[low])):
            low -= 1
        half = (diagonal[high - 1] - diagonal[high]) / 2
        shift = diagonal[high] - off[high - 1] ** 2 / (half + math.copysign(math.hypot(half, off[high - 1]), half))
        x, z = diagonal[low] - shift, off[low]
        for k in range(low, high):  # chase the bulge down the band
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                off[k - 1] = r
            p, o, w = diagonal[k], off[k], diagonal[k + 1]
            diagonal[k], diagonal[k + 1] = c * c * p + 2 * c * s * o + s * s * w, s * s * p - 2 * c * s * o + c * c * w
            off[k] = c * s * (w - p) + (c * c - s * s) * o
            if k + 1 < high:
                x, z = off[k], s * off[k + 1]
                off[k + 1] *= c
            columns[[k, k + 1]] = c * columns[k] + s * columns[k + 1], c * columns[k + 1] - s * columns[k]
    else:
        raise ArithmeticError("the eigenvalues didn't settle")
    order = np.argsort(-diagonal, kind="stable")
    return diagonal[order], columns[order].T


def whole_numbers(matrix: np.ndarray) -> np.ndarray:
    if len(matrix) and np.abs(matrix).max() > LARGEST:
        raise OverflowError("an entry is beyond 2**40")
    return np.floor(SCALE * matrix.astype(float)).astype(np.int64) + SHIFT


def usable(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """Rows with a whole vector of the most common length, and that length."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(column).isNotNull() & (F.size(column) > 0) & F.coalesce(finite, F.lit(False)))
    most = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most["d"] if most else 0
    return rows.filter(F.size(column) == d), d


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error, a row for each usable vector and component."""
    spark = vectors.sparkSession
    kinds = {id_column: vectors.schema[id_column].dataType, "component": IntegerType(), "n": LongType(), "deviation": LongType(), "whitened": DoubleType(), "explained": DoubleType(), "identity_error": DoubleType()}
    schema = StructType([StructField(c, kind) for c, kind in kinds.items()])
    rows, d = usable(vectors.select(id_column, column), column)
    if not d:
        return spark.createDataFrame([], schema)
    fit = moments(rows, column, d, lambda m: whole_numbers(m) - SHIFT)  # near zero, where doubles are finest
    values, directions = eigen(fit.covariance())
    many = min(components, d)
    values, directions, trace = values[:many], directions[:, :many], float(np.trace(fit.covariance()))
    varied = values > FLAT * max(values[0], 0.0)
    scale = np.where(varied, 1 / np.sqrt(np.where(varied, values, 1.0)), 0.0)
    n, sums = fit.n, [int(t) + fit.n * SHIFT for t in fit.total]
    whole = np.array([t // n for t in sums], np.int64)
    rest = np.array([t % n for t in sums], np.int64)  # x - S/n = (x - whole) - rest / n, without loss

    def projected(matrix: np.ndarray) -> np.ndarray:
        return ((whole_numbers(matrix) - whole) - rest / n) @ directions * scale

    seen = moments(rows, column, many, projected, exact=False).covariance()[np.ix_(varied, varied)]
    error = float(np.abs(seen - np.eye(len(seen))).max()) if len(seen) else 0.0
    explained = values / trace if trace > 0 else np.zeros(many)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 2_000):  # keeps a result batch small
                part = batch.iloc[begin : begin + 2_000]
                matrix = np.stack(part[column].to_numpy())
                centred = whole_numbers(matrix) - whole
                if ((n * centred.astype(float) - rest) ** 2).sum(axis=1).max() >= 2.0**63:
                    raise OverflowError("a deviation leaves 64 bits")
                away = n * centred - rest  # n x - S
                out = projected(matrix)
                out[:, ~varied] = np.nan
                whitened = pd.Series(out.ravel())
                yield pd.DataFrame(
                    {
                        id_column: part[id_column].repeat(many).to_numpy(),
                        "component": np.tile(np.arange(1, many + 1, dtype=np.int32), len(part)),
                        "n": n,
                        "deviation": (away * away).sum(axis=1).repeat(many),
                        "whitened": whitened.where(whitened.notna(), None),
                        "explained": np.tile(explained, len(part)),
                        "identity_error": error,
                    }
                )

    return rows.mapInPandas(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
