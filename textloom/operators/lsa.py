"""Latent semantic vectors: a truncated SVD of the weighted term-document matrix by randomised power iteration.

The matrix is a table of its non-zero entries. Each step is a join of that table with the vectors of the documents or of the terms, and a sum by the other: nothing of the size
of the corpus or the vocabulary meets in one place. Vectors are made orthonormal through their Gram matrix, whose sides are the rank, so only that goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written

RANK, EXTRA, ROUNDS = 32, 8, 4


def weights(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text)`` -> ``(doc_id, term, w)``, the weight ``ln(1 + tf) * (ln((1 + n) / (1 + df)) + 1)``, and ``(term, idf)``. Rows of one doc_id are one document; null texts have no words."""
    n = docs.agg(F.countDistinct("doc_id")).first()[0]
    words = docs.where("doc_id is not null").select("doc_id", F.explode(T.tokens("text")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    words = written(words, "words")
    idf = words.groupBy("term").agg((F.log((1.0 + n) / (1.0 + F.count("*"))) + 1).alias("idf"))
    idf = written(idf, "idf")
    return written(words.join(idf, "term").select("doc_id", "term", (F.log1p("tf") * F.col("idf")).alias("w")), "weights"), idf


def _times(entries: DataFrame, vectors: DataFrame, by: str, to: str, r: int) -> DataFrame:
    """``vectors(<by>, v)`` -> ``(<to>, v)``: each entry adds its weight times its ``by``'s vector to its ``to``."""
    sums = entries.join(vectors, by).groupBy(to).agg(*[F.sum(F.col("w") * F.col("v")[j]).alias(f"v{j}") for j in range(r)])
    return sums.select(to, F.array(*[f"v{j}" for j in range(r)]).alias("v"))


def _matrix(batch: pa.RecordBatch, r: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, r)


def gram(vectors: DataFrame, r: int) -> np.ndarray:
    """The sum over all rows of ``v v^T``, summed up by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((r, r))
        for batch in batches:
            m = _matrix(batch, r)
            total += m.T @ m
        yield pa.record_batch([pa.array(np.arange(r * r)), pa.array(total.ravel())], names=["k", "x"])

    out = np.zeros(r * r)
    for k, x in vectors.select("v").mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x")).collect():  # r * r rows
        out[k] = x
    return out.reshape(r, r)


def turned(vectors: DataFrame, by: str, m: np.ndarray, r: int) -> DataFrame:
    """Each vector times a small matrix."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _matrix(batch, r) @ m
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * m.shape[1]), pa.array(out.ravel()))
            yield pa.record_batch([batch.column(by), lists], names=[by, "v"])

    return vectors.select(by, "v").mapInArrow(run, f"{by} {kinds[by]}, v array<double>")


def _orthonormal(vectors: DataFrame, by: str, r: int) -> tuple[DataFrame, int]:
    """Vectors of the same span whose columns are orthonormal, and how many they are: directions that are nothing but rounding drop out. Twice, for precision."""
    vectors = written(vectors, "vectors")
    for _ in range(2):
        s, u = np.linalg.eigh(gram(vectors, r))
        keep = s > max(s.max(initial=0.0), 1e-300) * 1e-12
        vectors = written(turned(vectors, by, u[:, keep] / np.sqrt(s[keep]), r), "vectors")
        r = int(keep.sum())
    return vectors, r


def fit(docs: DataFrame, rank: int = RANK, extra: int = EXTRA, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """``docs(doc_id, text)`` -> ``(doc_id, v)``, ``(term, v, idf)`` and the singular values, largest first: the ``rank`` leading singular vectors of documents and of terms.

    A corpus of lower rank gives fewer. Documents without words have no vector; without any words there are no vectors and no values.
    """
    entries, idf = weights(docs)
    r = rank + extra
    sign = lambda j: F.when(F.xxhash64("term", F.lit(j)) % 2 == 0, 1.0).otherwise(-1.0)
    terms = idf.select("term", F.array(*[sign(j) for j in range(r)]).alias("v"))
    if entries.isEmpty():
        return entries.select("doc_id", F.array().cast("array<double>").alias("v")), terms.join(idf, "term"), np.zeros(0)
    for _ in range(rounds):
        found, r = _orthonormal(_times(entries, terms, "term", "doc_id", r), "doc_id", r)
        terms, r = _orthonormal(_times(entries, found, "doc_id", "term", r), "term", r)
    found, r = _orthonormal(_times(entries, terms, "term", "doc_id", r), "doc_id", r)
    # the matrix between these two spans is small: its decomposition turns them into the singular vectors
    terms = written(_times(entries, found, "doc_id", "term", r), "vectors")
    s, u = np.linalg.eigh(gram(terms, r))
    order = np.argsort(-s)[: min(rank, int((s > s.max() * 1e-12).sum()))]
    values, u = np.sqrt(s[order]), u[:, order]
    return written(turned(found, "doc_id", u, r), "documents"), written(turned(terms, "term", u / values, r).join(idf, "term"), "terms"), values


def embed(texts: DataFrame, terms: DataFrame, *ids: str) -> DataFrame:
    """``texts(<ids>, text)`` -> ``(<ids>, embedding)``: a text's weighted words times their vectors, scaled to length 1. Texts without a known word have none."""
    r = (terms.select(F.size("v").alias("n")).first() or {"n": 0})["n"]
    words = texts.select(*ids, F.explode(T.tokens("text")).alias("term")).groupBy(*ids, "term").agg(F.count("*").alias("tf"))
    sums = words.join(terms, "term").groupBy(*ids).agg(*[F.sum(F.log1p("tf") * F.col("idf") * F.col("v")[j]).alias(f"v{j}") for j in range(r)])
    v = F.array(*[f"v{j}" for j in range(r)]).cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return sums.select(*ids, F.transform(v, lambda x: F.try_divide(x, length)).alias("embedding"))
