"""Approximate vector index: an inverted file over product cells, product-quantised residuals, exact re-ranking.

A vector of unit length is cut into two halves; each half has the number of its nearest centroid, and the pair is the
vector's cell. So few centroids, fitted on a bounded sample, make many cells, and their number grows with the rows
(about the root of it). What is left after the centroids is cut into short parts, each with the number of the nearest
entry of its book: one byte a part. A row of the index is cell, id, code, and how far the decoded vector is off.

A search decodes the rows of the cells nearest to each query, keeps the best ``rerank`` of them by the decoded vectors, and scores
only these with their own vectors. ``exact`` scores every row that the errors don't rule out: as the decoded product is
off by the error at most, the result with all cells is that of a full scan. The k-th of a first search of few cells is a floor: cells
and rows that can't reach it are left out, and the others are scored where they lie, so that a block hands on k of each query.

Rows of a cell are dealt into blocks of bounded size, as are the queries at a cell, so no cell is one task's. The index is a table
sorted by cell; rows can be appended to it, coded by the same centroids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.operators.search import PRODUCT, _matrix, cosine
from loomdoc.session import cut

#: Rows that centroids and books are fitted on.
SAMPLE_ROWS = 20_000
#: Entries of a book: a code is a byte.
BOOK = 256
#: Components of a part of the residual.
PART = 4
#: Centroids of a half, at least and at most.
LEAST_CENTROIDS, MOST_CENTROIDS = 4, 1_024
#: Rows and queries of one cell that one task compares.
ROW_BLOCK, QUERY_BLOCK = 32_768, 2_048
#: The same of an exact search; small inputs are dealt into blocks of ``LEAST_BLOCK``, as long as there are cores without one.
EXACT_BLOCK, LEAST_BLOCK = 16_384, 1_024
#: Cells of the search that gives an exact one its floor.
AHEAD = 8
#: Rounding of products that are summed in another order.
CLOSE = 1e-9
BROADCAST_CELLS = 200_000


def k_means(m: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k centroids; those that lose their rows take those farthest from their own."""
    distinct = np.unique(m, axis=0)
    if len(distinct) <= k:
        return distinct
    centroids = distinct[np.linspace(0, len(distinct) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        distance = _distance(m, centroids)
        of = distance.argmin(axis=1)
        counts = np.bincount(of, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, m)
        held = counts > 0
        centroids[held] = sums[held] / counts[held, None]
        lost = np.flatnonzero(~held)
        if len(lost):
            centroids[lost] = m[np.argsort(-distance.min(axis=1), kind="stable")[: len(lost)]]
    return centroids


def _distance(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, less the rows' own squares."""
    return (centroids**2).sum(axis=1) - 2.0 * (m @ centroids.T)


@dataclass(frozen=True)
class Quantizer:
    """halves: the centroids of the two halves; books: the entries for each part of the residual."""

    halves: list[np.ndarray]
    books: list[np.ndarray]

    @property
    def cells(self) -> int:
        return len(self.halves[0]) * len(self.halves[1])

    def _split(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.halves[0].shape[1]
        return m[:, :d], m[:, d:]

    def _centroids(self, cells: np.ndarray) -> np.ndarray:
        return np.hstack([self.halves[0][cells // len(self.halves[1])], self.halves[1][cells % len(self.halves[1])]])

    def encode(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes and error of each row."""
        first, second = (_distance(h, c).argmin(axis=1) for h, c in zip(self._split(m), self.halves))
        cells = first * len(self.halves[1]) + second
        rest = m - self._centroids(cells)
        codes, at = np.zeros((len(m), len(self.books)), np.uint8), 0
        for k, book in enumerate(self.books):
            codes[:, k] = _distance(rest[:, at : at + book.shape[1]], book).argmin(axis=1)
            at += book.shape[1]
        return cells, codes, np.linalg.norm(m - self.decode(cells, codes), axis=1)

    def decode(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self._centroids(cells) + np.hstack([book[codes[:, k]] for k, book in enumerate(self.books)])

    def nearest(self, m: np.ndarray, probes: int) -> np.ndarray:
        """The cells nearest to each row. Of each half only as many centroids are looked at as could be in that many best sums."""
        parts = [_distance(h, c) for h, c in zip(self._split(m), self.halves)]
        held = [min(p.shape[1], probes) for p in parts]
        order = [np.argsort(p, axis=1, kind="stable")[:, :n] for p, n in zip(parts, held)]
        best = [np.take_along_axis(p, o, axis=1) for p, o in zip(parts, order)]
        # the i-th and j-th best of the halves have (i + 1)(j + 1) sums that are no larger, so a pair with more than ``probes`` of them isn't needed
        i, j = np.nonzero(np.outer(np.arange(1, held[0] + 1), np.arange(1, held[1] + 1)) <= max(probes, 1))
        sums = best[0][:, i] + best[1][:, j]
        chosen = np.argsort(sums, axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(order[0], i[chosen], axis=1) * len(self.halves[1]) + np.take_along_axis(order[1], j[chosen], axis=1)


def fit(sample: np.ndarray, rows: int) -> Quantizer:
    """For an index of so many rows. ``sample``: rows of unit length."""
    d = sample.shape[1]
    k = int(min(MOST_CENTROIDS, max(LEAST_CENTROIDS, round(rows**0.25)), max(1, len(sample) // 8)))
    half = max(1, d // 2)
    halves = [k_means(sample[:, :half], k), k_means(sample[:, half:], k) if d > half else np.zeros((1, 0))]
    plain = Quantizer(halves, [])
    cells = _distance(sample[:, :half], halves[0]).argmin(axis=1) * len(halves[1]) + (_distance(sample[:, half:], halves[1]).argmin(axis=1) if d > half else 0)
    rest = sample - plain._centroids(cells)
    return Quantizer(halves, [k_means(rest[:, at : at + PART], BOOK) for at in range(0, d, PART)])


@dataclass(frozen=True)
class VectorIndex:
    """rows: cell, id, code and error; vectors: id and vector, for the re-ranking."""

    rows: DataFrame
    vectors: DataFrame
    quantizer: Quantizer
    id_: str
    vector: str

    def search(self, queries: DataFrame, k: int, probes: int | None = None, rerank: int | None = None, exact: bool = False, counted: bool = False, same: bool = False) -> DataFrame:
        """query_id, id, similarity, rank: the k nearest rows of each query, its own row left out unless ``same`` (where the queries' ids are of another table). ``probes``: None for all cells.

        ``rerank`` rows of each query, at least k (20 k by default), are scored; ``exact``: those of all cells that the errors don't rule out. ``counted`` adds ``scored``, the number of rows that
        met in the last choice.
        """
        rerank = max(k, rerank or 20 * k)
        found = cut(self._exact(queries, k, same) if exact else self._candidates(queries, min(probes or self.quantizer.cells, self.quantizer.cells), rerank, same))
        found = F.broadcast(found) if found.count() <= BROADCAST_CELLS else found
        q = queries.select(F.col(self.id_).alias("query_id"), F.col(self.vector).alias("_q"))
        scored = found.join(self.vectors, self.id_).join(q, "query_id").select("query_id", self.id_, cosine(F.col(self.vector), F.col("_q")).alias("similarity"))
        by = Window.partitionBy("query_id")
        ranked = scored.withColumn("rank", F.row_number().over(by.orderBy(F.desc("similarity"), self.id_)))
        ranked = ranked.withColumn("scored", F.count(F.lit(1)).over(by)) if counted else ranked
        return ranked.filter(F.col("rank") <= k)

    def _candidates(self, queries: DataFrame, probes: int, rerank: int, same: bool) -> DataFrame:
        """query_id, id: the rows to score. Each block of a cell hands on its best, and these meet by query."""
        quantizer, id_, vector = self.quantizer, self.id_, self.vector
        cells_of = F.pandas_udf(lambda v: pd.Series(list(quantizer.nearest(_matrix(v), probes).astype(np.int32)) if len(v) else [], dtype=object), "array<int>")
        asked = queries.filter(F.col(vector).isNotNull()).select(F.col(id_).alias("query_id"), F.col(vector).alias("_q"), F.explode(cells_of(F.col(vector))).alias("cell"))
        blocks = lambda df, size, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).alias(name))
        sizes = cut(blocks(self.rows, ROW_BLOCK, "_rows").join(blocks(asked, QUERY_BLOCK, "_queries"), "cell"))
        sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_CELLS else sizes
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
        q = asked.join(sizes, "cell").withColumn("_a", block("query_id", "_queries")).withColumn("_b", every("_rows")).drop("_rows", "_queries")
        r = self.rows.join(sizes, "cell").withColumn("_b", block(id_, "_rows")).withColumn("_a", every("_queries")).drop("_rows", "_queries")

        def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = {"query_id": [], id_: [], "near": []}
            if len(a) and len(b):
                b = b.sort_values(id_, ignore_index=True)  # ties go by id
                decoded = quantizer.decode(b["cell"].to_numpy(), np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1))
                own = b[id_].to_numpy()
                for begin in range(0, len(a), PRODUCT):
                    part = a.iloc[begin : begin + PRODUCT]
                    asks = part["query_id"].to_numpy()
                    near = _matrix(part["_q"]) @ decoded.T
                    if not same:
                        near[asks[:, None] == own] = -np.inf
                    rows, columns = np.nonzero(_best(near, rerank) & np.isfinite(near))
                    for name, values in zip(out, (asks[rows], own[columns], near[rows, columns])):
                        out[name].append(values)
            return pd.DataFrame({name: np.concatenate(v) if v else [] for name, v in out.items()})

        kinds = dict(self.rows.dtypes)
        schema = f"query_id {kinds[id_]}, {id_} {kinds[id_]}, near double"
        keys = ["cell", "_a", "_b"]
        found = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(compare, schema)
        by = Window.partitionBy("query_id").orderBy(F.desc("near"), id_)
        return found.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= rerank).select("query_id", id_)

    def _exact(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """query_id, id: the k nearest rows of each query, and those as near up to rounding."""
        quantizer, id_, vector = self.quantizer, self.id_, self.vector
        first = self.search(queries, k, min(AHEAD, quantizer.cells), same=same).groupBy("query_id").agg(F.min("similarity").alias("_least"), F.count(F.lit(1)).alias("_n"))
        floors = first.filter(F.col("_n") == k).select("query_id", "_least")
        asked = queries.filter(F.col(vector).isNotNull()).select(F.col(id_).alias("query_id"), F.col(vector).alias("_q")).join(floors, "query_id", "left")
        asked = cut(asked.withColumn("_least", F.coalesce("_least", F.lit(-2.0))))
        cores = asked.sparkSession.sparkContext.defaultParallelism
        blocks = lambda n, size: max(1, -(-n // size), min(cores, n // LEAST_BLOCK))
        q_blocks, r_blocks = blocks(asked.count(), EXACT_BLOCK), blocks(self.rows.count(), EXACT_BLOCK)
        block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        q = asked.withColumn("_a", block("query_id", q_blocks)).withColumn("_b", every(r_blocks))
        r = self.rows.join(self.vectors.select(id_, F.col(vector).alias("_v")), id_).withColumn("_b", block(id_, r_blocks)).withColumn("_a", every(q_blocks))

        def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = {"query_id": [], id_: [], "near": []}
            if len(a) and len(b):
                # of equal vectors only the first k, and one more for a query that is one of them, can be among the best
                b = b.sort_values(id_, ignore_index=True)
                b = b[b.groupby([v.tobytes() for v in b["_v"]]).cumcount() <= k].reset_index(drop=True)
                codes = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1)
                decoded, m = quantizer.decode(b["cell"].to_numpy(), codes), _matrix(b["_v"])
                own, error = b[id_].to_numpy(), b["error"].to_numpy()
                cells, at = np.unique(b["cell"].to_numpy(), return_inverse=True)
                centroids, radius = quantizer._centroids(cells), np.zeros(len(cells))
                np.maximum.at(radius, at, np.linalg.norm(m - centroids[at], axis=1))
                for begin in range(0, len(a), PRODUCT):
                    part = a.iloc[begin : begin + PRODUCT]
                    asks, least, v = part["query_id"].to_numpy(), part["_least"].to_numpy()[:, None] - CLOSE, _matrix(part["_q"])
                    reached = np.flatnonzero(((v @ centroids.T + radius) >= least).any(axis=0)[at])
                    reached = reached[(v @ decoded[reached].T + error[reached] >= least).any(axis=0)]
                    s = v @ m[reached].T
                    s[s < least] = -np.inf
                    if not same:
                        s[asks[:, None] == own[reached]] = -np.inf
                    rows, columns = np.nonzero(_best(s, k, CLOSE) & np.isfinite(s))
                    for name, values in zip(out, (asks[rows], own[reached[columns]], s[rows, columns])):
                        out[name].append(values)
            return pd.DataFrame({name: np.concatenate(v) if v else [] for name, v in out.items()})

        kinds = dict(self.rows.dtypes)
        found = q.groupBy("_a", "_b").cogroup(r.groupBy("_a", "_b")).applyInPandas(compare, f"query_id {kinds[id_]}, {id_} {kinds[id_]}, near double")
        by = Window.partitionBy("query_id").orderBy(F.desc("near"), id_).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        last = F.nth_value("near", k).over(by)
        return found.withColumn("_least", last).filter(F.col("_least").isNull() | (F.col("near") >= F.col("_least") - CLOSE)).select("query_id", id_)

    def only(self, ids: DataFrame, column: str = "id") -> VectorIndex:
        """The index of the rows with these ids."""
        return VectorIndex(self.rows.join(ids.select(F.col(column).alias(self.id_)), self.id_, "left_semi"), self.vectors, self.quantizer, self.id_, self.vector)

    def append(self, vectors: DataFrame) -> VectorIndex:
        """With more rows, coded by the same centroids."""
        more = vectors.filter(F.col(self.vector).isNotNull()).select(self.id_, self.vector)
        return VectorIndex(self.rows.unionByName(_coded(more, self.quantizer, self.id_, self.vector)), self.vectors.unionByName(more), self.quantizer, self.id_, self.vector)

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """rows (sorted by cell, so a read of few cells skips the rest), vectors and centroids under ``path``."""
        self.rows.repartitionByRange("cell", self.id_).sortWithinPartitions("cell", self.id_).write.mode(mode).parquet(f"{path}/rows")
        self.vectors.write.mode(mode).parquet(f"{path}/vectors")
        q = self.quantizer
        tables = [("half", k, c.tolist()) for k, c in enumerate(q.halves)] + [("book", k, c.tolist()) for k, c in enumerate(q.books)]
        self.rows.sparkSession.createDataFrame(tables, "kind string, k int, entries array<array<double>>").coalesce(1).write.mode(mode).parquet(f"{path}/quantizer")

    @classmethod
    def read(cls, spark: SparkSession, path: str, id_: str = "id", vector: str = "embedding") -> VectorIndex:
        held = sorted(spark.read.parquet(f"{path}/quantizer").collect(), key=lambda r: r["k"])  # as large as the centroids
        array = lambda kind: [np.array(r["entries"], float).reshape(len(r["entries"]), -1) for r in held if r["kind"] == kind]
        return cls(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/vectors"), Quantizer(array("half"), array("book")), id_, vector)


def _best(near: np.ndarray, n: int, margin: float = 0.0) -> np.ndarray:
    """Which rows of a block are among a query's n best of it, those as good as the n-th included."""
    held = near.shape[1]
    return np.ones_like(near, bool) if held <= n else near >= np.partition(near, held - n, axis=1)[:, held - n, None] - margin


def _coded(vectors: DataFrame, quantizer: Quantizer, id_: str, vector: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cells, codes, error = quantizer.encode(_matrix(batch[vector]))
                yield pd.DataFrame({"cell": cells.astype(np.int32), id_: batch[id_].to_numpy(), "code": [c.tobytes() for c in codes], "error": error})

    return vectors.mapInPandas(run, f"cell int, {id_} {dict(vectors.dtypes)[id_]}, code binary, error double")


def _least(rows: DataFrame, id_: str, n: int, sample_rows: int) -> DataFrame:
    """The ``sample_rows`` rows of least hash, of ``n``. Tasks leave out what is beyond a hash that somewhat more rows should be below, as each would hand the driver as many rows as are wanted of all."""
    by, share = F.xxhash64(F.lit(5), id_), (sample_rows + 8 * sample_rows**0.5 + 8) / max(n, 1)
    held = rows if share >= 1 else rows.filter(by <= F.lit(int(share * 2**64) - 2**63))
    return held.orderBy(by, id_).limit(sample_rows)


def build(vectors: DataFrame, id_: str = "id", vector: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
    """Centroids and books from up to ``sample_rows`` rows (those of least hash); every row with a vector is coded."""
    rows = vectors.filter(F.col(vector).isNotNull()).select(id_, vector)
    n = rows.count()
    sample = _least(rows, id_, n, sample_rows).toPandas()
    if len(sample) < min(n, sample_rows):  # hashes that aren't even, as of equal ids
        sample = _least(rows, id_, sample_rows, sample_rows).toPandas()
    quantizer = fit(_matrix(sample[vector]) if len(sample) else np.zeros((1, 2)), n)
    return VectorIndex(cut(_coded(rows, quantizer, id_, vector)), rows, quantizer, id_, vector)


def probes_for(index: VectorIndex, queries: DataFrame, k: int, recall: float = 0.95, rerank: int | None = None) -> int:
    """The least number of cells, among powers of two, whose search finds that share of what a search of all cells does on ``queries`` (a small sample)."""
    whole = cut(index.search(queries, k, None, rerank).select("query_id", index.id_))
    n, probes = whole.count(), 1
    while probes < index.quantizer.cells and index.search(queries, k, probes, rerank).join(whole, ["query_id", index.id_]).count() < recall * n:
        probes *= 2
    return min(probes, index.quantizer.cells)
