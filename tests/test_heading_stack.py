"""The stack of headings worked out in blocks against the one that streams."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.sources import heading_stack, tables


@pytest.mark.parametrize("seed", range(3))
def test_summaries_compose(seed):
    rng = random.Random(seed)
    for _ in range(300):
        heads = [(rng.randint(1, heading_stack.DEPTH), f"h{k}") for k in range(rng.randint(0, 9))]
        start = [f"s{k}" for k in range(rng.randint(0, heading_stack.DEPTH))]
        cut = rng.randint(0, len(heads))
        path = start
        for n, text in heads:
            path = heading_stack.push(path, n, text)
        assert heading_stack.meet(heading_stack.meet(start, heading_stack.summary(heads[:cut])), heading_stack.summary(heads[cut:])) == path


@pytest.mark.parametrize("validated,rows", [(False, 7), (True, 1), (False, 5000)])
def test_blocks_equal_the_stream(spark, validated, rows, monkeypatch):
    monkeypatch.setattr(heading_stack.spread_sections, "__defaults__", (rows,))
    rng = random.Random(rows)
    made = []
    for doc, n in ((1, 150), (2, 1), (None, 40), (3, 3), (4, 90), (5, 0), (6, 2)):
        for k in range(n):
            text = rng.choice(["1.2 Some title", "Short", "A heading of middling length here", "x" * 70, "Figure 3", "2 Plain words", "Appendix B"]) + f" {k}"
            made.append((doc, k - k % 3, rng.choice([text, None]) if k % 17 == 0 else text, rng.choice(["heading", "text", "table"]), k))
    e = spark.createDataFrame(made, "doc_id long, elem_idx long, text string, type string, part int")
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    want = tables.with_sections(e, validated)
    got = tables.with_sections(e, validated, spread=True)
    assert got.columns == want.columns and plain(got) == plain(want)
    if validated:  # captions are no headings
        assert not any("Figure" in (r.section_path or "") for r in got.collect())
    assert tables.with_sections(e.limit(0), validated, spread=True).count() == 0


def test_one_document_goes_to_many_tasks(spark):
    n = 60_000
    e = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("elem_idx"), F.concat(F.lit("Heading "), F.col("id")).alias("text"), F.when(F.col("id") % 5 == 0, "heading").otherwise("text").alias("type"))
    out = tables.with_sections(e, spread=True)
    assert out.where(F.col("section_title") == F.concat(F.lit("Heading "), F.expr("(elem_idx - 1) div 5 * 5"))).count() == n - 1
    assert out.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1
