"""Indexes against exhaustive search: recall of probed cells, rows and work of pruned postings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import block_index, retrieval, vector_index


def vectors(spark, m, name="vec_id"):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], f"{name} long, embedding array<double>")


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    """Clustered vectors of 32 dimensions, some of them twice, and rows that no index can hold."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (40, 32))
    m = centres[rng.integers(0, 40, 3000)] + rng.normal(0, 0.35, (3000, 32))
    m[2900:] = m[:100]
    odd = spark.createDataFrame([(9001, None), (9002, [1.0, None] * 16), (9003, [float("inf")] * 32), (9004, [1.0]), (9005, []), (9006, [0.0] * 32)], "vec_id long, embedding array<double>")
    base = vectors(spark, m).union(odd)
    asked = vectors(spark, np.concatenate([m[::25] + rng.normal(0, 0.1, (120, 32))]), "query_id").union(odd.select(F.col("vec_id").alias("query_id"), "embedding"))
    index = vector_index.VectorIndex.build(base, f"file://{tmp_path_factory.mktemp('ivf')}/i")
    return base, asked, index


def hits(df):
    return {(r.query_id, r.vec_id): r.score for r in df.collect()}


def test_every_row_is_indexed_and_all_cells_are_exact(indexed):
    base, asked, index = indexed
    assert index.cells.count() == index.vectors.count() == 3001  # the zero vector too
    want = retrieval.vector_topk(base.where("vec_id NOT IN (9003, 9004)"), asked.where("query_id NOT IN (9003, 9004)"), 10)
    got = index.search(asked, 10, None, None)
    assert got.columns == ["query_id", "vec_id", "score", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_recall_of_probed_cells(indexed):
    base, asked, index = indexed
    asked = asked.where("query_id < 9000")
    exact = hits(retrieval.vector_topk(base.where("vec_id < 9000"), asked, 10))
    assert len(index.centres) == 55
    few = hits(index.search(asked, 10, probes=8, candidates=100))
    assert len(set(few) & set(exact)) >= 0.9 * len(exact)
    assert all(few[k] == pytest.approx(exact[k], abs=1e-6) for k in set(few) & set(exact))
    assert index.search(asked.limit(0), 10, 8).count() == 0


def test_recall_on_the_embeddings(spark, tmp_path):
    """Vectors almost without clusters: two thirds of the cells are needed."""
    base = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = base.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = vector_index.VectorIndex.build(base, f"file://{tmp_path}/i")
    exact = hits(retrieval.vector_topk(base, asked, 10))
    got = hits(index.search(asked, 10, probes=len(index.centres) * 2 // 3, candidates=200))
    assert len(set(got) & set(exact)) >= 0.9 * len(exact)


def test_index_of_few_rows(spark, tmp_path):
    index = vector_index.VectorIndex.build(vectors(spark, np.array([[1.0, 2.0, 3.0]])), f"file://{tmp_path}/one")
    assert hits(index.search(vectors(spark, np.array([[2.0, 4.0, 6.0]]), "query_id"), 5)) == {(0, 0): 1.0}
    with pytest.raises(ValueError, match="no vectors"):
        vector_index.VectorIndex.build(vectors(spark, np.array([[1.0]])).where("vec_id < 0"), f"file://{tmp_path}/none")


# Pruned postings


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Words of very different frequency, ties, nulls and empty texts; both indexes over them."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    rows = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60)))) for k in range(1500)]
    rows += [(1500 + k, rows[k][1]) for k in range(50)] + [(1600, None), (1601, ""), (1602, "W0 w0 W0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = tmp_path_factory.mktemp("words")
    asked = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 6)))) for k in range(40)] + [(40, None), (41, "unheard of"), (42, "w0 w1 w0"), (43, "w250 w251 w252 w253")]
    asked = spark.createDataFrame(asked, "query_id long, text string")
    return docs, asked, retrieval.Bm25Index.build(docs, f"file://{folder}/plain"), block_index.BlockIndex.build(docs, f"file://{folder}/blocks", range_docs=10)


@pytest.mark.parametrize("k,first", [(1, 1), (10, 4), (2000, 1)])
def test_pruned_search_finds_the_same(texts, k, first):
    docs, asked, plain, blocks = texts
    want = sorted(map(tuple, retrieval.ranked(retrieval.bm25(plain, asked), k).select("query_id", "doc_id", "score", "rank").collect()))
    got = sorted(map(tuple, blocks.topk(asked, k, first).select("query_id", "doc_id", "score", "rank").collect()))
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert all(g[2] == pytest.approx(w[2], abs=2e-6) for g, w in zip(got, want))


def test_pruned_search_reads_fewer_blocks(texts):
    _, asked, _, blocks = texts
    work = blocks.search(asked, 5, 3)[1].agg(F.sum("ranges").alias("n"), F.sum("scored").alias("scored")).first()
    assert 0 < work.scored < 0.7 * work.n


def test_negative_weights_are_not_pruned(spark, tmp_path):
    """Of two documents with one word in common the mean weight is negative too: nothing may be left out."""
    docs = spark.createDataFrame([(k, "a b" if k % 2 else "a") for k in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    blocks, plain = block_index.BlockIndex.build(docs, f"file://{tmp_path}/b", range_docs=4), retrieval.Bm25Index.build(docs, f"file://{tmp_path}/p")
    assert sorted(map(tuple, blocks.topk(asked, 5).collect())) == sorted(map(tuple, retrieval.ranked(retrieval.bm25(plain, asked), 5).select("query_id", "doc_id", "score", "rank").collect()))


def test_pruned_search_of_nothing(spark, texts, tmp_path):
    docs, asked, _, blocks = texts
    assert blocks.topk(asked.limit(0), 5).count() == 0
    assert block_index.BlockIndex.build(docs.limit(0), f"file://{tmp_path}/e").topk(asked, 5).count() == 0
