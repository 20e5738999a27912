"""A kept index for dense search: vectors in the cells of centroids, searched exactly.

Vectors are scaled to length 1, so cosine order is distance order. Each lies in the cell of its nearest centroid, and its
distance to it, its radius, is kept. Cells are partitions of plain Parquet tables, sorted by radius. For a question at
distance d from a centroid, a vector of radius r is at distance |d - r| or more (the triangle inequality), so once k vectors
of the nearest cells are scored, cells all of whose radii are too far from d are pruned at planning, and inside the others
rows by Parquet's statistics. The answer is that of the exhaustive search, whatever the centroids.

Centroids are fitted on a bounded sample: 64 vectors a cell, at most SAMPLE_BYTES, those with the smallest hashes of their
ids. New vectors are further runs. One writer at a time. Null, empty, zero and non-finite vectors, and those of another
length than the index's, have no cosine with its questions and are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.operators.retrieval import BLOCK_BYTES, best_in_tasks, top_k
from citelake.stages import written

#: Most bytes of vectors that centroids are fitted on, most cells of an index, and rounds of fitting.
SAMPLE_BYTES, MOST_CELLS, ROUNDS = 256 << 20, 4096, 8
#: Distances are known to this precision; scores are rounded to 9 digits, distances are about their square root.
SLACK = 1e-4
#: Cells whose radii are given to the scan as filters.
FEW_CELLS = 64


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", x, x)[:, None] - 2 * x @ centroids.T + np.einsum("ij,ij->i", centroids, centroids)[None, :]
    return np.sqrt(np.maximum(square, 0))


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit rows by Lloyd's rounds from the first distinct rows; empty cells keep their centroid."""
    _, first = np.unique(sample, axis=0, return_index=True)
    centroids = sample[np.sort(first)[:cells]].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([distances(sample[i : i + 4096], centroids).argmin(axis=1) for i in range(0, len(sample), 4096)])
        count = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, sample)
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    return centroids


class DenseIndex:
    """The index in a folder of the shared store. `read` tells, after a search, how many cells (of how many) and rows (of how
    many) the search could read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.read = spark, path.rstrip("/"), {}

    @staticmethod
    def usable(rows: DataFrame, vector: str, dim: int) -> DataFrame:
        """Rows with a vector of that many finite components, not all 0."""
        x = F.transform(vector, lambda e: e.cast("double"))
        fine = F.forall(x, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)) & ~F.isnan(e)) & F.exists(x, lambda e: e != 0)
        return rows.where((F.size(vector) == dim) & F.coalesce(fine, F.lit(False)))

    # writing

    def create(self, rows: DataFrame, dim: int, ordinal: str = "ordinal", vector: str = "vector", cells: int | None = None) -> None:
        """Fits centroids and writes rows (ordinal, vector) as the first run."""
        fine = self.usable(rows, vector, dim)
        cells = cells or min(MOST_CELLS, max(1, int(fine.count() ** 0.5)))
        some = fine.orderBy(F.xxhash64(ordinal), ordinal).limit(min(64 * cells, max(1, SAMPLE_BYTES // (8 * dim)))).select(vector).collect()
        centroids = fit(unit_rows(np.array([r[0] for r in some], np.float64)), cells) if some else np.zeros((1, dim))
        self.spark.createDataFrame(list(enumerate(centroids.tolist())), "cell int, centroid array<double>").coalesce(1).write.parquet(f"{self.path}/centroids")
        self.add(rows, ordinal, vector)

    def centroids(self) -> np.ndarray:
        return np.array([r["centroid"] for r in self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()])

    def add(self, rows: DataFrame, ordinal: str = "ordinal", vector: str = "vector") -> str:
        """A run of new vectors. It exists when its table of cells does. Rows are dealt out by ranges of cell, radius and id, so
        that a crowded cell is several tasks' and files'."""
        centroids, name = self.centroids(), f"run-{uuid.uuid4().hex}"
        sent = self.spark.sparkContext.broadcast(centroids)
        kind = rows.schema[ordinal].dataType.simpleString()
        slim = self.usable(rows, vector, centroids.shape[1]).select(F.col(ordinal).alias("ordinal"), F.col(vector).cast("array<double>").alias("vector"))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 1024):
                    b = whole.slice(start, 1024)
                    x = unit_rows(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1))
                    far = distances(x, sent.value)
                    near = far.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(far[np.arange(len(near)), near]), pa.array(near, pa.int32())], names=["ordinal", "vector", "radius", "cell"])

        placed = written(slim.mapInArrow(place, f"ordinal {kind}, vector array<double>, radius double, cell int"), "placed-vectors")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = placed.repartitionByRange(parts, "cell", "radius", "ordinal").sortWithinPartitions("cell", "radius")
        dealt.write.partitionBy("cell").option("compression", "zstd").parquet(f"{self.path}/vectors/{name}")
        placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("least"), F.max("radius").alias("most")).withColumn("run", F.lit(name)).coalesce(1).write.parquet(f"{self.path}/cells/{name}")
        return name

    # searching

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, query_vector) -> (query_id, ordinal, score, rank) as retrieval.dense_best() gives them, for questions in
        blocks of BLOCK_BYTES of vectors."""
        centroids = self.centroids()
        cells = self.spark.read.parquet(f"{self.path}/cells/*").collect()  # a row for each cell of each run
        asked = self.usable(queries, "query_vector", centroids.shape[1]).select("query_id", "query_vector")
        size = asked.count() * centroids.shape[1] * 8
        parts, found = max(1, -(-size // BLOCK_BYTES)), []
        self.read = {"cells": 0, "of_cells": 0, "rows": 0, "of_rows": 0}
        for part in range(parts):
            some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).collect()
            if some and cells:
                found.append(self._search(some, queries, centroids, cells, k))
        kind = queries.schema["query_id"].dataType.simpleString()
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], f"query_id {kind}, ordinal long, score double, rank int")

    def _search(self, asked: list, queries: DataFrame, centroids: np.ndarray, cells: list, k: int) -> DataFrame:
        vectors = unit_rows(np.array([r["query_vector"] for r in asked], np.float64))
        away = distances(vectors, centroids)
        n, least, most = np.zeros(len(centroids), np.int64), np.full(len(centroids), np.inf), np.full(len(centroids), -np.inf)
        for c in cells:
            n[c["cell"]] += c["n"]
            least[c["cell"]], most[c["cell"]] = min(least[c["cell"]], c["least"]), max(most[c["cell"]], c["most"])
        near = np.where(n > 0, away, np.inf)
        order = near.argsort(axis=1)
        # the nearest cells that hold k vectors give a distance that the k-th nearest vector does not exceed
        before = np.cumsum(n[order], axis=1) - n[order]
        first = np.zeros(away.shape, bool)
        np.put_along_axis(first, order, (before < k) & (n[order] > 0), axis=1)
        best = written(self._best(asked, queries, vectors, first, None, cells, k), "nearest-cells")
        worst = {r["query_id"]: r["score"] for r in best.groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
        reach = np.array([np.sqrt(max(0.0, 2 - 2 * worst[r["query_id"]])) + SLACK if r["query_id"] in worst else np.inf for r in asked])
        bound = np.maximum(np.maximum(away - most[None, :], least[None, :] - away), 0)
        wanted = (bound <= reach[:, None]) & (n > 0) & ~first
        self.read["cells"] += int((first | wanted).sum())
        self.read["of_cells"] += int((n > 0).sum()) * len(asked)
        self.read["rows"] += int(((first | wanted) * n[None, :]).sum())
        self.read["of_rows"] += int(n.sum()) * len(asked)
        if not wanted.any():
            return best
        more = self._best(asked, queries, vectors, wanted, (away, reach), cells, k)
        return top_k(best.drop("rank").unionByName(more.drop("rank")), k, F.desc(F.round("score", 9)), F.col("ordinal"))

    def _best(self, asked: list, queries: DataFrame, vectors: np.ndarray, wanted: np.ndarray, within: tuple | None, cells: list, k: int) -> DataFrame:
        """The k best of each question in the cells that it wants."""
        used = np.flatnonzero(wanted.any(axis=0)).tolist()
        runs = sorted({c["run"] for c in cells if wanted[:, c["cell"]].any()})
        rows = [self.spark.read.option("basePath", f"{self.path}/vectors/{r}").parquet(f"{self.path}/vectors/{r}").where(F.col("cell").isin(used)) for r in runs]
        rows = reduce(DataFrame.unionByName, rows)
        if within and len(used) <= FEW_CELLS:
            away, reach = within
            spans = [(c, wanted[:, c]) for c in used]
            rows = rows.where(reduce(lambda a, b: a | b, [(F.col("cell") == c) & F.col("radius").between(float((away[js, c] - reach[js]).min()), float((away[js, c] + reach[js]).max())) for c, js in spans]))
        sent = self.spark.sparkContext.broadcast((vectors, {c: np.flatnonzero(wanted[:, c]) for c in used}))

        def scorer():
            matrix, by_cell = sent.value

            def score(bodies: pa.Array) -> np.ndarray:
                out = np.full((len(bodies), len(matrix)), -np.inf)
                of, x = bodies.field("cell").to_numpy(zero_copy_only=False), unit_rows(bodies.field("vector").flatten().to_numpy().reshape(len(bodies), -1))
                for c in np.unique(of).tolist():
                    at = np.flatnonzero(of == c)
                    out[np.ix_(at, by_cell[c])] = x[at] @ matrix[by_cell[c]].T
                return out

            return score

        return best_in_tasks(rows, queries.select("query_id"), asked, k, F.struct("cell", "vector"), ["ordinal"], scorer)
