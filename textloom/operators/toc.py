"""Tables of contents: entries, parents, page ranges, subsections, paths and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written


def toc_pages(pages: DataFrame, search: int = 30) -> DataFrame:
    """Pages among the first ``search`` that look like a table of contents."""
    return pages.where((F.col("page_no") <= search) & T.is_toc_page("text"))


def entries(pages: DataFrame) -> DataFrame:
    """Every match of the four line patterns on ``pages(spec_id, page_no, text)``, titles cleaned up; a page number too large for a long is no entry."""
    hits = None
    for k, pattern in enumerate(T.TOC_PATTERNS):
        groups = [F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "number"), (2, "title"), (3, "page"))]
        own = pages.select("spec_id", F.col("page_no").alias("toc_page"), F.posexplode(F.arrays_zip(*groups)).alias("pos", "e"))
        own = own.select("spec_id", "toc_page", F.lit(k).cast("long").alias("pattern_used"), F.col("pos").cast("long").alias("pos"), F.col("e.number").alias("section_number"), T.clean_toc_title("e.title").alias("section_title"), F.col("e.page").try_cast("long").alias("page_number")).where("page_number is not null")
        hits = own if hits is None else hits.union(own)
    return hits.withColumn("level", T.level("section_number"))


def first_of_each(hits: DataFrame) -> DataFrame:
    w = Window.partitionBy("spec_id", "section_number").orderBy("toc_page", "pattern_used", "pos")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def missing_parents(found: DataFrame) -> DataFrame:
    """Prefixes that no entry has, with the page of their first child."""
    spread = found.select("spec_id", F.explode(T.parent_prefixes("section_number")).alias("section_number"), "page_number")
    spread = spread.groupBy("spec_id", "section_number").agg(F.min("page_number").alias("page_number"))
    return spread.join(found.select("spec_id", "section_number"), ["spec_id", "section_number"], "left_anti")


def with_parents(found: DataFrame) -> DataFrame:
    """The entries and their inferred parents, with ``ord``: originals by section key, then the inferred ones by theirs."""
    new = missing_parents(found).select("spec_id", "section_number", F.concat(F.lit("Section "), "section_number", F.lit(" [Inferred]")).alias("section_title"), "page_number", T.level("section_number").alias("level"), F.lit(True).alias("inferred"))
    old = found.select("spec_id", "section_number", "section_title", "page_number", "level", F.lit(False).alias("inferred"))
    w = Window.partitionBy("spec_id").orderBy("inferred", T.section_key("section_number"))
    return old.unionByName(new).withColumn("ord", F.row_number().over(w).cast("long"))


def page_ranges(found: DataFrame, last_page: DataFrame, long_pages: int = 10) -> DataFrame:
    """``found(..., page_number, ord)``, ``last_page(spec_id, last_page)``: an entry ends before the next one by (page, ord) starts."""
    w = Window.partitionBy("spec_id").orderBy("page_number", "ord")
    after = F.lead("page_number").over(w)
    out = found.join(last_page, "spec_id").withColumn("page_start", F.col("page_number"))
    out = out.withColumn("page_end", F.greatest("page_number", F.coalesce(after - 1, F.col("last_page"))))
    out = out.withColumn("page_count", F.col("page_end") - F.col("page_start") + 1)
    return out.withColumn("is_long", F.col("page_count") > long_pages).drop("last_page")


def subsections(parents: DataFrame, pages: DataFrame) -> DataFrame:
    """Numbered lines one level below a parent, on its pages: lines are taken once per page and joined by parent and page."""
    pattern = T.SUBSECTION_LINE
    zipped = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "number"), (2, "title"))])
    lines = pages.select("spec_id", "page_no", F.posexplode(zipped).alias("pos", "e"))
    title = F.trim(F.regexp_replace(F.regexp_replace("e.title", r"\s*\.{2,}\s*\d+\s*$", ""), r"\s{2,}", " "))
    lines = lines.select("spec_id", F.col("page_no").alias("page_number"), "pos", F.col("e.number").alias("section_number"), title.alias("section_title")).where(F.length("section_title") >= 3)
    lines = lines.withColumn("parent", F.regexp_replace("section_number", r"\.\d+$", ""))
    asked = parents.where("NOT inferred AND level <= 3 AND page_start <= page_end").select("spec_id", F.col("section_number").alias("parent"), F.explode(F.sequence("page_start", "page_end")).alias("page_number"))
    found = lines.join(asked, ["spec_id", "parent", "page_number"])
    w = Window.partitionBy("spec_id", "section_number").orderBy("page_number", "pos")
    found = found.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return found.select("spec_id", "parent", "section_number", "section_title", "page_number", T.level("section_number").alias("level"))


def section_paths(found: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """``(spec_id, section_number, section_path)``: number and title of every prefix and of the section itself, joined by arrows.

    Titles come from ``lookup`` (default: ``found``), by numbers without a final dot; of several the first by ``ord`` or, without that column, the
    smallest. A prefix without a title, or one that only says it is inferred, shows its number alone. Repeated sections give a row each of their own title.
    """
    bare = lambda c: F.rtrim(F.col(c), F.lit("."))
    lookup = found if lookup is None else lookup
    first = F.min_by("section_title", "ord") if "ord" in lookup.columns else F.min("section_title")
    titles = lookup.groupBy("spec_id", bare("section_number").alias("prefix")).agg(first.alias("title"))
    own = found.select("spec_id", "section_number", "section_title").distinct()
    prefixes = F.concat(T.parent_prefixes(bare("section_number")), F.array(bare("section_number")))
    own = own.select("spec_id", "section_number", "section_title", F.posexplode(prefixes).alias("pos", "prefix"))
    title = F.when(F.col("prefix") == bare("section_number"), F.col("section_title")).otherwise(F.col("title"))
    part = F.when(F.coalesce(title, F.lit("")).isin("", "[Inferred]"), F.col("prefix")).otherwise(F.concat("prefix", F.lit(" "), title))
    joined = own.join(titles, ["spec_id", "prefix"], "left").groupBy("spec_id", "section_number", "section_title").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("t"))
    return joined.select("spec_id", "section_number", F.array_join(F.transform("t", lambda x: x["part"]), " → ").alias("section_path"), "section_title")


def headed_pages(pages: DataFrame) -> DataFrame:
    """``(spec_id, page_no)`` of the pages with a numbered heading."""
    return pages.where(F.col("text").rlike(T.SECTION_LINE)).select("spec_id", F.col("page_no").cast("long").alias("page_no")).distinct()


def headed_coverage(pages: DataFrame) -> DataFrame:
    """``(spec_id, total, headed, pct, feasibility, proceed)``: how many of a document's pages have a numbered heading."""
    rows = pages.groupBy("spec_id", "page_no").agg(F.max(F.coalesce(F.col("text").rlike(T.SECTION_LINE), F.lit(False))).alias("headed"))
    out = rows.groupBy("spec_id").agg(F.count("*").alias("total"), F.count_if("headed").alias("headed"))
    pct = F.round(100.0 * F.col("headed") / F.col("total"), 6)
    return out.select("spec_id", "total", "headed", pct.alias("pct"), T.feasibility(pct).alias("feasibility"), T.proceed(pct).alias("proceed"))


def unheaded_pages(pages: DataFrame) -> DataFrame:
    """Pages with text but no numbered heading."""
    with_text = pages.where(F.coalesce("text", F.lit("")) != "").select("spec_id", F.col("page_no").cast("long").alias("page_no"))
    return with_text.subtract(headed_pages(pages))


def stored_chunks(chunks: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Chunks of ``chunk_document`` (columns ``chunk_index`` and ``total_chunks`` if split) -> ``(chunk_id, doc_id, text, page_numbers, page_end, section_title,
    section_path, chunk_type, token_count)`` as the store keeps them.

    The path runs over ``entries`` (default: the chunks) and ends in the subtitle, if there is one; a chunk cites its start page (0 if unknown). Ids are hashes of
    document, section, start page and index, so ingesting again gives the same ones.
    """
    chunks = written(chunks, "sections")
    paths = section_paths(chunks.select("spec_id", "section_number", "section_title"), entries)
    index = F.col("chunk_index") if "chunk_index" in chunks.columns else F.lit(0)
    out = chunks.join(paths, ["spec_id", "section_number", "section_title"], "left")
    return out.select(
        T.stable_id("spec_id", "section_number", "page_start", index).alias("chunk_id"), F.col("spec_id").alias("doc_id"), F.coalesce("content", F.lit("")).alias("text"),
        F.array(F.coalesce("page_start", F.lit(0))).alias("page_numbers"), "page_end", "section_title", T.path_with_subtitle("section_path", "subtitle").alias("section_path"),
        F.lit("text").alias("chunk_type"), T.token_estimate(F.coalesce("content", F.lit(""))).alias("token_count"),
    )


def out_of_order(found: DataFrame) -> DataFrame:
    """Entries whose section key is below the previous one's, in page order."""
    w = Window.partitionBy("spec_id").orderBy("page_number", "ord")
    key = T.section_key("section_number")
    return found.withColumn("previous", F.lag("section_number").over(w)).where(T.section_key("previous") > key).select("spec_id", "previous", "section_number")


def sibling_gaps(found: DataFrame) -> DataFrame:
    """Children of one parent whose last number does not follow the previous child's."""
    own = found.where(F.col("section_number").contains(".")).select("spec_id", F.regexp_replace("section_number", r"\.[^.]*$", "").alias("parent"), F.element_at(F.split("section_number", r"\."), -1).try_cast("long").alias("last"))
    w = Window.partitionBy("spec_id", "parent").orderBy("last")
    return own.withColumn("previous", F.lag("last").over(w)).where("last <> previous + 1").select("spec_id", "parent", "previous", "last")


def toc_quality(found: DataFrame) -> DataFrame:
    """``(spec_id, issues, score)``: two points off for each of at most five missing parents, short titles and misplaced entries."""
    capped = lambda df, name: df.groupBy("spec_id").agg(F.least(F.count("*"), F.lit(5)).alias(name))
    parts = [capped(missing_parents(found), "a"), capped(found.where(F.length("section_title") < 10), "b"), capped(out_of_order(found), "c")]
    out = found.select("spec_id").distinct()
    for p in parts:
        out = out.join(p, "spec_id", "left")
    issues = sum((F.coalesce(F.col(c), F.lit(0)) for c in "abc"), F.lit(0).cast("long"))
    return out.select("spec_id", issues.alias("issues"), F.greatest(F.lit(0).cast("long"), 100 - 2 * issues).alias("score"))


def chunk_document(pages: DataFrame, page_offset: int = 0) -> DataFrame:
    """Pages of documents to sections with content: entries, parents, ranges, subsections, texts, subtitles and recovered titles.

    ``pages(spec_id, page_no, text)``; entry pages are ``page_offset`` below the page numbers. A document without a table of contents gives no rows; a section
    whose pages have no text has none either.
    """
    pages = written(pages, "pages")  # read four times
    found = written(with_parents(first_of_each(entries(toc_pages(pages)))), "entries")
    last = pages.groupBy("spec_id").agg((F.max("page_no") - page_offset).cast("long").alias("last_page"))
    ranges = page_ranges(found, last)
    subs = subsections(ranges, pages.withColumn("page_no", F.col("page_no") - page_offset))
    subs = subs.select("spec_id", "section_number", "section_title", "level", F.lit(False).alias("inferred"), F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"))
    every = written(ranges.select(subs.columns).unionByName(subs), "ranges")
    from ..sources.tables import range_content

    texts = range_content(pages, every.select("spec_id", "section_number", "page_start", "page_end").distinct(), page_offset)
    out = every.join(texts, ["spec_id", "section_number"])
    title = F.when(F.col("inferred"), F.coalesce(T.recovered_title("content", "section_number"), "section_title")).otherwise(F.col("section_title"))
    return out.withColumn("section_title", title).withColumn("subtitle", T.subtitle("content", "section_number")).withColumn("content", T.clean_content("content", "section_number"))
