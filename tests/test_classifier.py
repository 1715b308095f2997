"""Naive Bayes, plugs for classes and entities, feedback words and latency sketches, against plain Python."""

import datetime
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.operators import answers, classifier, retrieval, store


def test_naive_bayes_against_python(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(20)]
    rows = [(" ".join(rng.choices(words[6 * c : 6 * c + 10], k=rng.randint(0, 8))), "abc"[c]) for c in (rng.randrange(3) for _ in range(60))] + [(None, "c"), ("w1 w1", None), ("", "lone")]
    asked = [(k, " ".join(rng.choices(words + ["new"], k=rng.randint(0, 6)))) for k in range(30)] + [(None, "w3"), (31, None), (32, "new new")]
    model = classifier.fit(spark.createDataFrame(rows, "text string, label string").withColumn("term", F.lit(1)))
    kept = [((t or "").split(), c) for t, c in rows if c is not None]
    count, total, n = defaultdict(Counter), Counter(), Counter(c for _, c in kept)
    for w, c in kept:
        count[c].update(w)
        total[c] += len(w)
    known = {w for c in count.values() for w in c}
    want = {}
    for k, t in asked:
        own = [w for w in (t or "").split() if w in known]
        score = {c: math.log(n[c] / len(kept)) + sum(math.log((count[c][w] + 1) / (total[c] + len(known))) for w in own) for c in n}
        best = max(sorted(score), key=lambda c: round(score[c], 6))
        want[k] = best, score[best]
    got = {r.id: (r.label, r.score) for r in classifier.classify(spark.createDataFrame(asked, "id long, text string"), model, "id").collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-5) for k in want)


def test_fit_is_bounded(spark):
    rows = spark.range(4000).select(F.concat_ws(" ", F.lit("t"), "id").alias("text"), F.lit("x").alias("label"))
    assert 300 < classifier.fit(rows, 500)[1].count() < 800


def test_classes_and_entities_by_a_caller(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "boom"), (3, "odd")], "query_id long, text string")

    def name(row):
        if row["text"] == "boom":
            raise OSError("down")
        return {"a": " Comparison ", "odd": "poetry"}[row["text"]]

    got = {r.query_id: (r.query_type, r.strategy, r.top_k) for r in answers.plan(rows, classifier=name).collect()}
    assert got == {1: ("comparison", "hybrid", 15), 2: ("factual", "vector", 10), 3: ("factual", "vector", 10)}
    found = {r.query_id: (r.entities, r.entities_error) for r in answers.found_entities(rows, lambda r: ["B", "A", "B"] if r["text"] == "a" else 1 / 0).collect()}
    assert found[1] == (["A", "B"], None) and found[2] == ([], "ZeroDivisionError: division by zero")
    assert answers.found_entities(spark.createDataFrame([("Some Name and Some",)], "text string")).first().entities == ["Name", "Some"]


def test_feedback_words_against_python(spark):
    docs = {1: "a b b c", 2: "b d", 3: "", 4: "z z z"}
    queries, hits = [(1, "a x a"), (2, "q"), (3, None)], [(1, 1, 3.0), (1, 2, 1.0), (3, 4, 2.0), (1, 3, 0.5)]
    got = {(r.query_id, r.term): r.times for r in retrieval.expanded(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(hits, "query_id long, doc_id long, score double"), spark.createDataFrame(list(docs.items()), "doc_id long, text string"), terms=2).collect()}
    fed = Counter()
    for _, doc, score in hits[:2]:
        for w in docs[doc].split():
            fed[w] += score / 4.5 / len(docs[doc].split())
    want = {(1, "a"): 0.5 * 2 / 3 + 0.5 * (fed["a"] if "a" in [w for w, _ in fed.most_common(2)] else 0), (1, "x"): 0.5 / 3, (2, "q"): 1.0, (3, "z"): 0.5}
    for w, x in sorted(fed.items(), key=lambda i: (-i[1], i[0]))[:2]:
        want[1, w] = 0.5 * x + (0.5 * 2 / 3 if w == "a" else 0)
    want[1, "a"] = want.get((1, "a"), 0.5 * 2 / 3)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_merged_latencies_keep_their_bound(spark):
    rng = random.Random(4)
    days = [datetime.datetime(2024, 3, 4) + datetime.timedelta(days=k) for k in range(14)]
    rows = [(rng.choice("ab"), rng.choice(days), rng.lognormvariate(3, 1)) for _ in range(30_000)] + [("a", None, 1.0), ("a", days[0], None)]
    audit = spark.createDataFrame(rows, "model string, ts timestamp, latency_ms double")
    sketches = store.latency_sketches(audit)
    assert sketches.count() == 28
    for by in ((), ("model",)):
        for r in store.latency_quantiles(sketches, (0.1, 0.5, 0.99), 7, *by).collect():
            own = sorted(x for m, t, x in rows if t is not None and x is not None and r.since <= t.date() < r.since + datetime.timedelta(days=7) and (not by or m == r.model))
            assert r.n == len(own) and len(own) > 1000
            for q, v in zip((0.1, 0.5, 0.99), r.quantiles):
                assert abs(sum(x <= v for x in own) / len(own) - q) < 0.035
    assert store.latency_quantiles(store.latency_sketches(audit.limit(0))).count() == 0
