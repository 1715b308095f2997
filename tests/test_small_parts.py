"""Parts without a query: page openings, joined paths, instructions, log lines, search with filters."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from textloom import log
from textloom.functions import text as T
from textloom.operators import answers, retrieval
from textloom.sources import tables


def test_openings_of_pages(spark):
    pages = spark.createDataFrame([("d", k, f"page {k} " * 50) for k in range(1, 6)], "doc_id string, page_no int, text string")
    got = tables.inspect_pages(pages, 2, 3, 12).orderBy("page_no").collect()
    assert [(r.page_no, r.shown) for r in got] == [(2, "page 2 page "), (3, "page 3 page ")] and "text" not in got[0]


def test_joined_path(spark):
    row = spark.range(1).select(T.joined_path(F.array(F.lit("a"), F.lit("b"))).alias("p"), T.joined_path(F.array().cast("array<string>")).alias("none")).first()
    assert (row.p, row.none) == ("a > b", None)


def test_instructions_of_every_type(spark):
    kinds = spark.createDataFrame([(k,) for k in [*answers.INSTRUCTIONS, "unheard", None]], "kind string")
    got = {r.kind: r.said for r in kinds.select("kind", answers.instructions("kind").alias("said")).collect()}
    assert got == {**answers.INSTRUCTIONS, "unheard": answers.ANY_INSTRUCTION, None: answers.ANY_INSTRUCTION}


def test_log_lines_are_json(tmp_path):
    logger = log.set_up(path=str(tmp_path / "log"))
    try:
        logger.info("took %s", "d1")
        try:
            raise ValueError("bad")
        except ValueError:
            logger.exception("failed")
    finally:
        for h in list(logger.handlers):
            logger.removeHandler(h)
    lines = [json.loads(x) for x in (tmp_path / "log").read_text().splitlines()]
    assert [x["message"] for x in lines] == ["took d1", "failed"] and lines[1]["level"] == logging.getLevelName(logging.ERROR) and "ValueError: bad" in json.dumps(lines[1])


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = [(k, f"d{k % 4}", f"common word{k % 5} text {'rare' if k in (1, 2) else ''}", f"s{k % 2}", [k]) for k in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id string, text string, section_path string, pages array<int>").withColumn("embedding", retrieval.hashed_vector("text"))
    registry = spark.createDataFrame([("d0", "p", True), ("d1", "p", False), ("d2", "q", True), ("d3", "q", True)], "doc_id string, protocol string, is_active boolean")
    return chunks.cache(), registry, retrieval.Bm25Index.build(chunks.select(F.col("chunk_id").alias("doc_id"), "text"), f"file://{tmp_path_factory.mktemp('index')}/i")


@pytest.mark.parametrize("strategy", ["vector", "hybrid"])
def test_filters_hold_before_the_cut(spark, corpus, strategy):
    """Three hits each, though the best of all chunks are others; words keep the weight of the whole corpus."""
    chunks, registry, index = corpus
    planned = answers.plan(spark.createDataFrame([(1, "rare word3")], "query_id long, text string"), top_k=3, min_score=0.0, strategy=strategy)
    asked = planned.select("query_id", retrieval.hashed_vector("text").alias("embedding"))
    of = {r.chunk_id: r.doc_id for r in chunks.select("chunk_id", "doc_id").collect()}
    for given, docs in (({}, {"d0", "d1", "d2", "d3"}), ({"doc_id": "d3"}, {"d3"}), ({"protocol": "p"}, {"d0", "d1"}), ({"protocol": "p", "active_only": True}, {"d0"}), ({"active_only": True}, {"d0", "d2", "d3"}), ({"doc_id": "none"}, set())):
        got = answers.search(planned, asked, chunks, index, registry, deep=6, **given).collect()
        assert len(got) == (3 if docs else 0) and {of[r.doc_id] for r in got} <= docs and all(r.of_doc == of[r.doc_id] for r in got), given
    words = {r.doc_id: r.score for r in retrieval.bm25(index, planned).collect()}
    assert words[2] > 0 and 2 in {r.doc_id for r in answers.search(planned, asked, chunks, index, registry, doc_id="d2", deep=6).collect()}
