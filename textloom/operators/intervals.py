"""Ranges of pages by their end points: merging, counting, gaps and the pages that none covers, without spreading a range to its pages.

Ranges are ``(<by>, page_start, page_end)``, both ends included; one that ends before it starts, or has a null end, covers nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pages of a block; ranges that start in one block are merged before they meet those of others.
BLOCK_PAGES = 4096


def merged(ranges: DataFrame, by: str = "spec_id") -> DataFrame:
    """Disjoint ranges that cover the same pages, no two of them adjacent.

    A range is one row, and a running maximum of the ends tells where the next merged range begins. Ranges of one block of pages are merged first, so that of
    a document with a great many overlapping ranges few rows are sorted together in the end.
    """
    own = ranges.where("page_start <= page_end").select(by, F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"))
    block = F.floor(F.col("page_start") / BLOCK_PAGES)
    return _merged(_merged(own.withColumn("block", block), by, "block").drop("block"), by)


def _merged(ranges: DataFrame, *keys: str) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy("page_start", "page_end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("page_start") > F.max("page_end").over(before) + 1, F.lit(True))
    upto = Window.partitionBy(*keys).orderBy("page_start", "page_end").rowsBetween(Window.unboundedPreceding, 0)
    runs = ranges.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(upto))
    return runs.groupBy(*keys, "run").agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end")).drop("run")


def covered(ranges: DataFrame, by: str = "spec_id") -> DataFrame:
    """``(<by>, covered)``: how many pages some range covers."""
    return merged(ranges, by).groupBy(by).agg(F.sum(F.col("page_end") - F.col("page_start") + 1).alias("covered"))


def gaps(ranges: DataFrame, last_page: DataFrame, by: str = "spec_id", first: int = 1) -> DataFrame:
    """``(<by>, first_page, last_page)``: the stretches from page ``first`` to a document's ``last_page(<by>, last_page)`` that no range covers."""
    own = merged(ranges, by).select(by, "page_start", "page_end")
    edge = last_page.select(by, (F.col("last_page") + 1).cast("long").alias("page_start"), F.lit(None).cast("long").alias("page_end"))
    w = Window.partitionBy(by).orderBy("page_start", F.desc_nulls_last("page_end"))
    # a range that starts beyond the last page ends nothing; the edge closes the last gap
    rows = own.join(last_page.select(by, F.col("last_page").cast("long").alias("to")), by).where(F.col("page_start") <= F.col("to")).drop("to").unionByName(edge)
    rows = rows.withColumn("first_page", F.greatest(F.coalesce(F.lag("page_end").over(w) + 1, F.lit(first).cast("long")), F.lit(first).cast("long")))
    return rows.select(by, "first_page", (F.col("page_start") - 1).alias("last_page")).where("first_page <= last_page")


def outside(pages: DataFrame, ranges: DataFrame, by: str = "spec_id") -> DataFrame:
    """Distinct ``(<by>, page_no)`` of ``pages`` that no range covers: pages and merged ranges pass by in one order, the latest end so far tells."""
    own = merged(ranges, by).select(by, F.col("page_start").alias("page_no"), "page_end")
    asked = pages.select(by, F.col("page_no").cast("long").alias("page_no"), F.lit(None).cast("long").alias("page_end")).distinct()
    w = Window.partitionBy(by).orderBy("page_no", F.desc_nulls_last("page_end")).rowsBetween(Window.unboundedPreceding, 0)
    swept = own.unionByName(asked).withColumn("to", F.max("page_end").over(w))
    return swept.where(F.col("page_end").isNull() & (F.col("to").isNull() | (F.col("to") < F.col("page_no")))).select(by, "page_no")


def islands(pages: DataFrame, by: str = "spec_id") -> DataFrame:
    """Runs of consecutive ``(<by>, page_no)``: ``(<by>, first_page, last_page)``."""
    own = merged(pages.select(by, F.col("page_no").alias("page_start"), F.col("page_no").alias("page_end")), by)
    return own.select(by, F.col("page_start").alias("first_page"), F.col("page_end").alias("last_page"))
