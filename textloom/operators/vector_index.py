"""An inverted-file index over vectors: cells by k-means, residuals as product codes, probed by cell and re-ranked exactly.

Centroids and codebooks are fitted on a bounded sample; every row is assigned to its cell and coded. A search reads the cells nearest to each query, scores
their codes by table lookups, and works out the exact cosine of each query's best candidates from the vectors, which lie apart from the codes. With ``candidates=None``
the vectors of the probed cells are scored exactly and no codes are read; with all cells probed that is the exact answer.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import Best, _matrix, _unit

#: Rows that centroids and codebooks are fitted on, at most, whatever the number of rows.
FIT_ROWS = 20_000
MOST_CELLS = 4096
CODE_PARTS, CODE_VALUES = 16, 256
#: Queries times probed cells sent to the executors at once.
MOST_PROBES = 1_000_000
_HITS = "query_id long, id long, score double"


def _kmeans(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd on a bounded array; an empty cell takes the row that lies farthest from its centre."""
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        near, far = _nearest(rows, centres)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        empty = np.flatnonzero(count == 0)
        centres[empty] = rows[np.argsort(-far)[: len(empty)]]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its squared distance."""
    near, far, own = np.zeros(len(rows), np.int64), np.zeros(len(rows)), (centres**2).sum(1)
    for a in range(0, len(rows), step):
        d = own - 2 * rows[a : a + step] @ centres.T
        near[a : a + step] = d.argmin(1)
        far[a : a + step] = d.min(1) + (rows[a : a + step] ** 2).sum(1)
    return near, far


def _usable(v) -> F.Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


class VectorIndex:
    """``cells`` (cell, id, codes), ``vectors`` (cell, id, v), both in the order of cells, and the model that they were made with.

    Vectors are scaled to length 1. Null vectors, empty ones, those with null or non-finite elements and those of another length than most of the sample's are left out; zero
    vectors score 0. Ids are longs and need not be unique.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path
        self.cells, self.vectors = spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/vectors")
        said = json.loads(spark.read.text(f"{path}/model").first()[0])
        self.centres, self.books = np.array(said["centres"]), np.array(said["books"])

    @classmethod
    def build(cls, base: DataFrame, path: str, n_cells: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", fit_rows: int = FIT_ROWS, seed: int = 7) -> VectorIndex:
        """Fit on about ``fit_rows`` rows, chosen by a hash of their id, and index every row. ``n_cells``: by default the root of the number of rows."""
        spark = base.sparkSession
        rows = base.where(_usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        n = rows.count()
        share = 1 << 20 if n <= fit_rows else math.floor(fit_rows / n * (1 << 20))
        fitted = rows.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)) < share)
        dims = fitted.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        if dims is None:
            raise ValueError("no vectors to index")
        dim = dims["dim"]
        sample = _unit(_matrix(fitted.where(F.size("v") == dim).limit(2 * fit_rows).toArrow()["v"], dim))  # bounded by fit_rows
        rng = np.random.default_rng(seed)
        k = min(n_cells or max(1, round(math.sqrt(n))), MOST_CELLS, len(sample))
        centres = _kmeans(sample, k, 10, rng)
        parts = math.gcd(CODE_PARTS, dim)
        rest = (sample - centres[_nearest(sample, centres)[0]]).reshape(len(sample), parts, -1)
        books = np.stack([_kmeans(rest[:, p], min(CODE_VALUES, len(sample)), 8, rng) for p in range(parts)])

        def assign(batches):
            for batch in batches:
                v = _unit(_matrix(batch.column("v"), dim))
                cell = _nearest(v, centres)[0]
                left = (v - centres[cell]).reshape(len(v), parts, -1)
                codes = np.stack([_nearest(left[:, p], books[p])[0] for p in range(parts)], 1).astype(np.uint8)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * dim), pa.array(v.ravel()))
                yield pa.record_batch([pa.array(cell.astype(np.int32)), batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), lists], names=["cell", "id", "codes", "v"])

        placed = rows.where(F.size("v") == dim).mapInArrow(assign, "cell int, id long, codes binary, v array<double>")
        placed = placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
        placed.write.mode("overwrite").option("parquet.block.size", 16_000_000).parquet(f"{path}/vectors")
        spark.read.parquet(f"{path}/vectors").select("cell", "id", "codes").write.mode("overwrite").option("parquet.block.size", 4_000_000).parquet(f"{path}/cells")
        said = json.dumps({"centres": centres.tolist(), "books": books.tolist()})
        spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, candidates: int | None = 200, id_col: str = "vec_id") -> DataFrame:
        """``queries(query_id, embedding)`` -> ``(query_id, <id>, score, rank)`` as of ``vector_topk``, among the ``probes`` cells nearest to each query (None: all).

        ``candidates``: of so many rows by their codes the exact score is worked out; None: of all rows of the probed cells. Queries go to the executors in blocks of
        ``MOST_PROBES`` probes.
        """
        dim, n_cells = self.centres.shape[1], len(self.centres)
        probes = min(probes or n_cells, n_cells)
        asked = queries.where(_usable(F.col("embedding")) & (F.size("embedding") == dim)).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
        n = asked.count()
        blocks, every = max(1, -(-n * probes // MOST_PROBES)), None
        for b in range(blocks if n else 0):
            own = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
            if not len(own):
                continue
            q = _unit(_matrix(own["embedding"], dim))
            near = np.argpartition((self.centres**2).sum(1) - 2 * q @ self.centres.T, probes - 1, axis=1)[:, :probes]
            part = self._found(own["query_id"].to_numpy(), q, near, k, candidates)
            every = part if every is None else every.union(part)
        if every is None:
            return self._spark.createDataFrame([], f"query_id long, {id_col} long, score double, rank long")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return every.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "score", "rank")

    def _found(self, ids: np.ndarray, q: np.ndarray, near: np.ndarray, k: int, candidates: int | None) -> DataFrame:
        cells, at = np.unique(near), np.argsort(near.ravel(), kind="stable")
        cut = np.searchsorted(near.ravel()[at], np.arange(len(self.centres) + 1))
        sent = self._spark.sparkContext.broadcast((ids, q, (at // near.shape[1]).astype(np.int32), cut, self.centres, self.books))
        probed = F.col("cell").isin(cells.tolist()) if len(cells) < min(len(self.centres), 1000) else F.lit(True)
        if candidates is None:
            return self.vectors.where(probed).select("cell", "id", "v").mapInArrow(_score_cells(sent, k, False), _HITS)
        most = max(k, candidates)
        rough = self.cells.where(probed).mapInArrow(_score_cells(sent, most, True), _HITS)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        rough = rough.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("query_id", "id").distinct()
        held = self.vectors.where(probed).select("id", "v").join(rough, "id").select("query_id", "id", "v")
        return held.mapInArrow(_exact(sent), _HITS)


def _score_cells(sent, most: int, coded: bool):
    """The best rows of each query among a partition's cells, by codes or by vectors; a cell's rows meet only the queries that probe it."""

    def run(batches):
        ids, q, who, cut, centres, books = sent.value
        held = Best(len(ids), most)
        for batch in batches:
            cell, own = batch.column("cell").to_numpy(), batch.column("id").to_numpy()
            order = np.argsort(cell, kind="stable")
            edges = np.append(np.flatnonzero(np.diff(cell[order], prepend=-1)), len(order))
            if coded:
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(own), -1)
            else:
                v = _matrix(batch.column("v"), q.shape[1])
            for a, b in zip(edges, edges[1:]):
                c, rows = int(cell[order[a]]), order[a:b]
                asking = who[cut[c] : cut[c + 1]]
                if not len(asking):
                    continue
                if coded:
                    table = np.einsum("qpj,pej->qpe", q[asking].reshape(len(asking), len(books), -1), books)
                    score = q[asking] @ centres[c]
                    score = score[:, None] + sum(table[:, p][:, codes[rows, p]] for p in range(len(books)))
                else:
                    score = np.round(q[asking] @ v[rows].T, 6)
                held.add_some(asking, score, own[rows])
        for row, own, score in held.rows():
            yield pa.record_batch([pa.array(ids[row]), pa.array(own), pa.array(score + 0.0)], names=["query_id", "id", "score"])

    return run


def _exact(sent):
    def run(batches):
        ids, q = sent.value[:2]
        place = np.argsort(ids, kind="stable")
        for batch in batches:
            own = batch.column("query_id").to_numpy()
            at = place[np.searchsorted(ids, own, sorter=place)]
            score = np.round(np.einsum("rd,rd->r", _matrix(batch.column("v"), q.shape[1]), q[at]), 6)
            yield pa.record_batch([batch.column("query_id"), batch.column("id"), pa.array(score + 0.0)], names=["query_id", "id", "score"])

    return run
