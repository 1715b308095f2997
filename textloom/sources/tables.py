"""Sources: Parquet tables, page texts, layout elements, binary files behind a parser of the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .heading_stack import push, spread_sections


# Fixed value: the tags that make an element.
TAGS = ("h1", "h2", "h3", "p", "li", "figcaption", "table")
#: Pages of a bin, by which ranges and pages meet.
BIN_PAGES = 64
#: An element ends with the closing tag of its own kind, so that a table keeps the paragraphs in its cells.
ELEMENT = rf"(?s)<({'|'.join(TAGS)})\b[^>]*>(.*?)</\1>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_from_binaries(spark: SparkSession, path: str, parse: Callable[[bytes], Iterable[str]], glob: str = "*.pdf") -> DataFrame:
    """``(doc_id, page_no, text)`` from files; ``parse`` turns a file's bytes into its pages' texts (a PDF library goes here).

    doc_id is the MD5 of the bytes; pages count from 1; empty pages are left out.
    """

    def run(batches):
        for batch in batches:
            rows = [(d, k, t) for d, c in zip(batch["doc_id"], batch["content"]) for k, t in enumerate(parse(bytes(c)), 1) if t]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.md5("content").alias("doc_id"), "content").mapInPandas(run, "doc_id string, page_no int, text string")


def page_range(pages: DataFrame, ranges: DataFrame, offset: int = 0) -> DataFrame:
    """Pages of each ``ranges(spec_id, section_number, page_start, page_end)``: a range goes to its bins of ``BIN_PAGES`` pages, a page to its own."""
    first, last = (F.col(c) + offset for c in ("page_start", "page_end"))
    bin_of = lambda page: F.floor(page / BIN_PAGES)
    spread = ranges.where("page_start <= page_end").select("spec_id", "section_number", first.alias("_first"), last.alias("_last"), F.explode(F.sequence(bin_of(first), bin_of(last))).alias("_bin"))
    found = pages.withColumn("_bin", bin_of(F.col("page_no"))).join(spread, ["spec_id", "_bin"])
    return found.where(F.col("page_no").between(F.col("_first"), F.col("_last"))).drop("_bin", "_first", "_last")


def range_content(pages: DataFrame, ranges: DataFrame, offset: int = 0) -> DataFrame:
    """``(spec_id, section_number, content)``: the pages' texts in order, joined by a blank line."""
    found = page_range(pages, ranges, offset).groupBy("spec_id", "section_number")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"])
    return found.agg(F.array_join(texts, "\n\n").alias("content"))


def html_elements(pages: DataFrame) -> DataFrame:
    """``(page_id, elem_idx, type, text)`` from the h1-h3, p, li, figcaption and table tags of ``pages(page_id, html)``, in order; blank ones are left out. Null pages have none."""
    pattern = ELEMENT
    bare = F.regexp_replace("html", r"(?s)<(script|style)\b.*?</(script|style)>", "")
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(F.regexp_extract_all(bare, F.lit(pattern), F.lit(1)).alias("tag"), F.regexp_extract_all(bare, F.lit(pattern), F.lit(2)).alias("body"))).alias("pos", "e"))
    text = F.trim(F.regexp_replace(F.regexp_replace("e.body", "<[^>]*>", ""), r"[ \t\n\r]+", " "))
    kind = F.when(F.col("e.tag").startswith("h"), "heading").when(F.col("e.tag") == "li", "list_item").when(F.col("e.tag") == "figcaption", "figure_caption").when(F.col("e.tag") == "table", "table").otherwise("text")
    return rows.select("page_id", F.col("pos").cast("long").alias("elem_idx"), kind.alias("type"), text.alias("text")).where("text <> ''")


def with_sections(elements: DataFrame, validated: bool = False, spread: bool = False) -> DataFrame:
    """``elements(doc_id, elem_idx, type, text, ...)`` with ``section_title`` and ``section_path``: the latest heading before an element, and the headings above
    each other, joined by ' > '; a heading still has those before it. Nulls before the first one.

    A heading's level comes from its length; ``validated``: from its number, 4 at most, and headings that are none (captions, page numbers, too long) change nothing. A document
    streams through one task, or, with ``spread``, through as many as its blocks need; equal ``elem_idx`` go by text. A heading without a text is none.
    """
    level = T.heading_level("text") if validated else T.level_by_length("text")
    level = F.when(level > 4, 4).otherwise(level) if validated else level
    rows = elements.withColumn("_level", F.when((F.col("type") == "heading") & F.col("text").isNotNull(), level).cast("int"))
    if spread:
        return spread_sections(rows).drop("_level")
    out = rows.withColumns({"section_title": F.lit(None).cast("string"), "section_path": F.lit(None).cast("string")})
    names = out.columns

    def run(batches):
        doc, path, title, fresh = None, [], None, True
        for batch in batches:
            titles, paths = [], []
            for d, n, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_level", "text"))):
                if fresh or d != doc:
                    doc, path, title, fresh = d, [], None, False
                titles.append(title)
                paths.append(" > ".join(path) if path else None)
                if n is not None:
                    path, title = push(path, n, text), text
            columns = [*(batch.column(k) for k in range(batch.num_columns - 2)), pa.array(titles, pa.string()), pa.array(paths, pa.string())]
            yield pa.record_batch(columns, names=names)

    return out.repartition("doc_id").sortWithinPartitions("doc_id", "elem_idx", "text").mapInArrow(run, out.schema).drop("_level")


def inspect_pages(pages: DataFrame, first: int, last: int, chars: int = 2000) -> DataFrame:
    """The openings of a range of pages, to look at."""
    return pages.where(F.col("page_no").between(first, last)).select("*", F.substring("text", 1, chars).alias("shown")).drop("text")
