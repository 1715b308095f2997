"""Bounds on BM25 scores by range of documents, and a search that scores only ranges that can still matter.

A range is a few documents that lie beside each other in a task of the build, so that the tables are written where the texts are read and nothing is shuffled. For each range and term the index
knows the highest part of a score that a document can get, without the term's weight. A search works in steps:

1. bounds: for each query and range the sum of its terms' highest parts times their weights, read from a narrow table without documents;
2. a first guess: the ``FIRST_RANGES`` ranges of the highest bounds are scored; a query's k-th best score there is its threshold;
3. the rest: ranges whose bound reaches the threshold are scored, the others are not.

Scores are those of ``retrieval.bm25``. Where a query has a term of negative weight, the parts bound nothing, and all its ranges are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .retrieval import RANGE_DOCS, Bm25Index, asked_words, ranked, scores, small, term_weights

#: Ranges scored for a first threshold, for each query.
FIRST_RANGES = 8


def _highest(avgdl: float, k1: float, b: float):
    """Rows of documents -> ``(rng, term, part)``: the highest part of each term of a range; twice, if a task's batches cut the range, which only lifts its bound."""

    def run(batches):
        for batch in batches:
            own, begin = batch.column("rng").to_numpy(), 0
            cuts = np.flatnonzero(np.diff(own)) + 1
            for end in [*cuts.tolist(), len(own)]:
                part = batch.slice(begin, end - begin)
                begin = end
                if not part.num_rows:
                    continue
                # a document of several lengths hits once for each: its parts add up
                tf = part.column("tfs").flatten().to_numpy().astype(float)
                row = np.repeat(np.arange(part.num_rows), part.column("tfs").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                value = np.zeros(len(tf))
                lengths = part.column("dls").to_pylist()
                for nth in range(max(map(len, lengths))):
                    dl = np.array([np.inf if nth >= len(x) or x[nth] is None else x[nth] for x in lengths], float)[row]
                    value += tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                words = part.column("terms").flatten()
                best = pa.table({"term": words, "part": value}).group_by("term").aggregate([("part", "max")])
                for x in best.combine_chunks().to_batches(100_000):
                    yield pa.record_batch([pa.array(np.full(x.num_rows, own[end - 1])), x.column("term"), x.column("part_max")], names=["rng", "term", "part"])

    return run


class BlockIndex:
    """A ``Bm25Index`` and ``bounds(rng, term, part)``, as Parquet under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.index, self.bounds = Bm25Index(spark, path), spark.read.parquet(f"{path}/bounds")
        self.k1, self.b, self.epsilon = spark.read.parquet(f"{path}/fixed").select("k1", "b", "epsilon").first()

    @classmethod
    def build(cls, chunks: DataFrame, path: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, range_docs: int = RANGE_DOCS) -> BlockIndex:
        """``chunks(doc_id, text)``; null texts are documents without words and length. ``k1``, ``b`` and ``epsilon`` hold for all searches."""
        spark = chunks.sparkSession
        index = Bm25Index.build(chunks, path, range_docs)
        docs = index.docs.where("doc_id is not null").select("rng", "dls", "terms", "tfs")
        docs.mapInArrow(_highest(index.stats.first()["avgdl"], k1, b), "rng long, term string, part double").write.mode("overwrite").parquet(f"{path}/bounds")
        index.stats.select(*[F.lit(float(x)).alias(n) for n, x in (("k1", k1), ("b", b), ("epsilon", epsilon))]).coalesce(1).write.mode("overwrite").parquet(f"{path}/fixed")
        return cls(spark, path)

    def topk(self, queries: DataFrame, k: int, first_ranges: int = FIRST_RANGES) -> DataFrame:
        """``queries(query_id, text)`` -> ``(query_id, doc_id, score, rank)``: the k best of positive score, ties to the smaller doc_id."""
        return self.search(queries, k, first_ranges)[0]

    def search(self, queries: DataFrame, k: int, first_ranges: int = FIRST_RANGES) -> tuple[DataFrame, DataFrame]:
        """The hits, and ``(query_id, ranges, scored)``: of how many ranges with a term of the query how many were scored."""
        weights = term_weights(self.index, asked_words(queries), self.epsilon)
        bounds = self.bounds.join(small(weights), "term").groupBy("query_id", "rng").agg(F.sum(F.col("weight") * F.col("part")).alias("bound"), F.min("weight").alias("least"))
        bounds = written(bounds, "bounds")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "rng"))
        best = bounds.select("query_id", "rng", place.alias("place"), F.lit(True).alias("best")).where(F.col("place") <= first_ranges).drop("place")
        first = bounds.join(small(written(best, "best")), ["query_id", "rng"], "left").where(F.coalesce("best", F.col("least") < 0)).select("query_id", "rng")
        first = written(first, "first")
        guessed = written(ranked(self._scored(weights, first, k), k), "guessed")
        least = small(written(guessed.where(F.col("rank") == k).select("query_id", F.col("score").alias("reach")), "reached"))
        # scores are rounded to 6 places, so a bound within one more of the threshold may still tie with it
        rest = bounds.join(least, "query_id", "left").where(F.col("reach").isNull() | (F.col("bound") >= F.col("reach") - 2e-6)).select("query_id", "rng")
        rest = written(rest.join(small(first), ["query_id", "rng"], "left_anti"), "rest")
        every = guessed.drop("rank").unionByName(self._scored(weights, rest, k))
        read = first.union(rest).groupBy("query_id").agg(F.count("*").alias("scored"))
        work = bounds.groupBy("query_id").agg(F.count("*").alias("ranges")).join(read, "query_id", "left").fillna(0, ["scored"])
        return ranked(every, k), work

    def _scored(self, weights: DataFrame, ranges: DataFrame, k: int) -> DataFrame:
        """``(query_id, doc_id, score)``: the best of each task among the documents of some queries' ranges; ranges that nobody asks for are not read on."""
        asking = small(written(ranges.groupBy("rng").agg(F.collect_list("query_id").alias("asking")), "asking"))
        docs = self.index.docs.join(asking, "rng").select("doc_id", "dls", "terms", "tfs", "asking")
        return scores(self.index, weights, k, self.k1, self.b, docs)
