"""The keyword index: a row a document, scored where it is read; hits worked out once."""

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.operators import answers, block_index, retrieval, toc
from textloom.plans import queries as plans

#: Documents that share an id, of equal and of unequal lengths, and some of no id.
ROWS = [(1, "a b c"), (1, "a b d"), (2, "a a"), (2, "c"), (3, "b c d e"), (4, None), (4, None), (5, "A\tc"), (None, "a c"), (None, "e"), (6, "f g h"), (7, "g"), (8, "h i j")]
ASKED = [(1, "a c"), (2, "e E b"), (3, None), (4, "unheard of")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs, asked = spark.createDataFrame(ROWS, "doc_id long, text string"), spark.createDataFrame(ASKED, "query_id long, text string")
    folder = tmp_path_factory.mktemp("keyword")
    return docs, asked, retrieval.Bm25Index.build(docs, f"file://{folder}/a"), block_index.BlockIndex.build(docs, f"file://{folder}/b", range_docs=2)


def by_sql():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", ROWS)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", ASKED)
    return con.execute(plans.SQL["q_bm25_batch"]).fetchall(), con.execute(plans.SQL["q_bm25_stats"]).fetchall()[0]


def test_rows_of_one_id_and_of_none_are_as_in_sql(built):
    _, asked, index, blocks = built
    want, stats = by_sql()
    key = lambda r: (r[0], r[3])
    for got in (retrieval.bm25_topk(index, asked, 10), blocks.topk(asked, 10, 1)):
        assert [(*r[:2], pytest.approx(r[2], abs=2e-6), r[3]) for r in sorted(map(tuple, got.collect()), key=key)] == sorted(want, key=key)
    assert tuple(index.stats.first()) == pytest.approx(stats, abs=1e-6)


def test_only_hits_are_shuffled(built):
    """All scores come without an exchange, the best with that of their ranks alone."""
    _, asked, index, _ = built
    assert "Exchange" not in plan_of(retrieval.bm25(index, asked))
    assert plan_of(retrieval.bm25_topk(index, asked, 3)).count("Exchange hashpartitioning") == 1


def test_blocks_of_queries_and_kept_documents(spark, built, monkeypatch):
    docs, asked, index, _ = built
    keep = docs.where("doc_id IN (1, 3, 5)").select("doc_id")
    whole = sorted(map(tuple, retrieval.ranked(retrieval.bm25(index, asked).join(keep.distinct(), "doc_id", "left_semi").select("query_id", "doc_id", "score"), 2).collect()))
    for name, value in (("MOST_TERMS", 1), ("MOST_SENT", 0), ("MOST_SUMMANDS", 10), ("MOST_COUNTED", 1)):
        monkeypatch.setattr(retrieval, name, value)
        assert sorted(map(tuple, retrieval.bm25_topk(index, asked, 2, keep).collect())) == whole


def test_simple_mode_builds_no_keyword_index(spark, sf_dir, monkeypatch):
    def fail(*_):
        raise AssertionError("the simple mode asks for no words")

    monkeypatch.setattr(plans, "_index", fail)
    assert plans.q_simple_mode(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()


def test_hits_of_an_answer_are_worked_out_once(spark):
    planned = answers.plan(spark.createDataFrame([(0, "what is it")], "query_id long, text string"))
    hits = spark.range(3).select(F.lit(0).cast("long").alias("query_id"), (F.col("id") + 1).alias("rank"), F.lit(0.9).alias("score"), F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("p").alias("section_path"), F.array(F.lit(1)).alias("pages"))
    out = answers.answer(planned, hits)
    assert "Range" not in plan_of(out) and out.first()["num_chunks"] == 3


def test_pages_of_documents_are_worked_out_once(spark):
    pages = spark.range(3).select(F.lit(1).cast("long").alias("spec_id"), (F.col("id") + 1).alias("page_no"), F.lit("Contents\n2.1 Some heading here ...... 2").alias("text"))
    out = toc.chunk_document(pages)
    assert "Range (" not in plan_of(out) and out.count() > 0
