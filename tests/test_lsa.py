"""Singular vectors by distributed power iteration against NumPy's decomposition."""

import random

import numpy as np
import pytest

from textloom.operators import lsa


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    topics = [[f"t{t}w{k}" for k in range(12)] for t in range(6)]
    texts = {}
    for d in range(120):
        own = topics[d % 6]
        texts[d] = " ".join(rng.choices(own, range(12, 0, -1), k=rng.randint(5, 40)) + rng.choices(["the", "of", "and"], k=10) + rng.choices(sum(topics, []), k=3))
    docs = spark.createDataFrame([*texts.items(), (500, None), (501, ""), (None, "t0w1")], "doc_id long, text string")
    return docs, lsa.fit(docs, rank=6, extra=6, rounds=6)


def dense(docs):
    entries = lsa.weights(docs)[0].collect()
    rows, cols = sorted({e.doc_id for e in entries}), sorted({e.term for e in entries})
    m = np.zeros((len(rows), len(cols)))
    for e in entries:
        m[rows.index(e.doc_id), cols.index(e.term)] = e.w
    return m, rows, cols


def test_singular_vectors(corpus):
    docs, (found, terms, values) = corpus
    m, rows, cols = dense(docs)
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    assert values == pytest.approx(s[:6], rel=1e-4)
    a = np.array([r.v for r in sorted(found.collect(), key=lambda r: r.doc_id)])
    b = np.array([r.v for r in sorted(terms.collect(), key=lambda r: cols.index(r.term))])
    assert a.shape == (len(rows), 6) and b.shape == (len(cols), 6)
    for own, want in ((a, u[:, :6]), (b, vt[:6].T)):
        assert np.abs(own.T @ own - np.eye(6)).max() < 1e-6
        assert np.linalg.svd(want.T @ own)[1].min() > 0.9999  # the cosine of the largest angle between the spaces
    assert np.abs(a * values @ b.T - u[:, :6] * s[:6] @ vt[:6]).max() < 0.05 * s[0] / np.sqrt(len(rows))


def test_texts_of_a_topic_are_near(spark, corpus):
    _, (_, terms, _) = corpus
    texts = spark.createDataFrame([(1, "t0w0 t0w1 the"), (2, "t0w3 t0w2 of"), (3, "t4w0 t4w1 the"), (4, "never seen"), (5, None)], "id long, text string")
    v = {r.id: np.array(r.embedding) for r in lsa.embed(texts, terms, "id").collect()}
    assert set(v) == {1, 2, 3} and v[1] @ v[2] > 0.8 and v[1] @ v[3] < 0.6 and all(abs(x @ x - 1) < 1e-9 for x in v.values())


def test_low_rank_and_no_words(spark):
    docs = spark.createDataFrame([(k, "a b") for k in range(5)], "doc_id long, text string")
    found, terms, values = lsa.fit(docs, rank=4, extra=2, rounds=1)
    assert len(values) == 1 and found.count() == 5 and terms.count() == 2 and len(found.first().v) == 1
    assert lsa.fit(docs.where("doc_id < 0"), rank=2)[0].count() == 0
