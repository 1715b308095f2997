"""Ranges by their end points against sets of pages."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import intervals
from textloom.sources import tables


@pytest.mark.parametrize("seed,block", [(1, 4096), (2, 7), (3, 1)])
def test_ranges_against_sets_of_pages(spark, seed, block, monkeypatch):
    monkeypatch.setattr(intervals, "BLOCK_PAGES", block)
    rng = random.Random(seed)
    ranges = [(rng.choice([1, 1, 2, None]), a := rng.randint(-3, 60), a + rng.choice([-2, 0, 0, 1, 5, 20])) for _ in range(45)] + [(3, 5, None), (3, None, 9), (1, 10, 12), (1, 10, 12)]
    pages = [(rng.choice([1, 2, 3, None]), rng.randint(1, 70)) for _ in range(150)]
    r = spark.createDataFrame([(*x, "s") for x in ranges], "spec_id int, page_start int, page_end int, block string")
    p = spark.createDataFrame([(*x, "t") for x in pages], "spec_id int, page_no int, text string")
    cover = {}
    for s, a, b in ranges:
        if a is not None and b is not None:
            cover.setdefault(s, set()).update(range(a, b + 1))

    def runs(numbers):
        out = []
        for n in sorted(numbers):
            if out and out[-1][1] == n - 1:
                out[-1][1] = n
            else:
                out.append([n, n])
        return out

    rows = lambda df: sorted((tuple(x) for x in df.collect()), key=str)
    assert rows(intervals.merged(r)) == sorted(((s, *x) for s, c in cover.items() for x in runs(c)), key=str)
    assert rows(intervals.covered(r)) == sorted(((s, len(c)) for s, c in cover.items() if c), key=str)
    left = {(s, n) for s, n in pages} - {(s, n) for s, c in cover.items() for n in c}
    assert rows(intervals.outside(p, r)) == sorted(left, key=str)
    of = {}
    for s, n in pages:
        of.setdefault(s, set()).add(n)
    assert rows(intervals.islands(p)) == sorted(((s, *x) for s, c in of.items() for x in runs(c)), key=str)
    last = {1: 66, 2: 15, 3: 8, 4: 2}
    lasts = spark.createDataFrame(list(last.items()), "spec_id int, last_page int")
    assert rows(intervals.gaps(r, lasts)) == sorted(((s, *x) for s, n in last.items() for x in runs(set(range(1, n + 1)) - cover.get(s, set()))), key=str)
    found = tables.page_range(p, r.withColumn("section_number", F.concat_ws("-", "page_start", "page_end")), 2)
    want = [(s, n, f"{a}-{b}") for s, a, b in ranges if a is not None and b is not None and s is not None for s2, n in pages if s == s2 and a + 2 <= n <= b + 2]
    assert rows(found.select("spec_id", "page_no", "section_number")) == sorted(want, key=str)


def test_long_ranges_are_not_spread(spark):
    r = spark.range(50).select(F.lit(1).alias("spec_id"), (F.col("id") * 900_000).alias("page_start"), (F.col("id") * 900_000 + 999_999).alias("page_end"))
    for plan in (intervals.covered(r), intervals.outside(r.select("spec_id", F.col("page_end").alias("page_no")), r)):
        assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()
    assert intervals.covered(r).first().covered == 49 * 900_000 + 1_000_000
    assert intervals.merged(r.limit(0)).count() == 0 and intervals.outside(r.selectExpr("spec_id", "page_end AS page_no").limit(0), r).count() == 0
