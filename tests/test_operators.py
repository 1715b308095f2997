"""Values and rules that SQL does not show: scores, packers, chunk factory, store, streaming."""

import os

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import answers, chunking, retrieval, sections, store, toc
from textloom.sources import tables
from textloom.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("score,answer,want", [(0.85, "so [1]", 0.935), (0.8, "so", 0.48), (0.7, "I cannot answer that [1]", 0.35), (None, "x", 0.0), (0.99, "[2]", 1.0)])
def test_confidence(spark, score, answer, want):
    assert one(spark, T.confidence(F.lit(score).cast("double"), F.lit(answer))) == pytest.approx(want)


@pytest.mark.parametrize("title,want", [("6.6.34.1 Title", [6, 6, 34, 1]), ("B.2.6 Title", [2, 6]), ("Introduction", []), (None, [])])
def test_section_numbers(spark, title, want):
    assert one(spark, T.section_numbers(F.lit(title).cast("string"))) == want and chunking._numbers(title) == want


@pytest.mark.parametrize("a,b,want", [("6.6 A", "6.7 B", True), ("6.6.34.1 A", "6.6.34.2 B", False), ("6.6 A", "6.6.1 B", True), ("A", "A", False), ("Chapter 6", "Chapter 7", True), ("B.2.5 x", "B.2.6 y", True), ("Introduction", "6.1 x", True), ("", "6.1 x", False)])
def test_major_change(spark, a, b, want):
    assert one(spark, T.major_change(F.lit(a), F.lit(b))) is want and chunking.is_major(a, b) is want


def test_section_key_sorts_words_last(spark):
    assert one(spark, T.section_key(F.lit("Appendix B.2."))) == [999, 2]


def test_json_of_answer(spark):
    assert one(spark, T.json_of_answer(F.lit('{"k": 3}'), "k long"))["k"] == 3
    assert one(spark, T.json_of_answer(F.lit('Here:\n```json\n{"k": 4}\n```'), "k long"))["k"] == 4
    assert one(spark, T.json_of_answer(F.lit("none"), "k long")) is None


def test_rerank_and_fusion(spark):
    hits = spark.createDataFrame([(1, "a", 1, "A", 0.5), (1, "b", 2, "A", 0.5), (1, "c", 3, "B", 0.6)], "query_id long, id string, rank long, section string, score double")
    out = {r.id: (r.new_score, r.new_rank) for r in retrieval.rerank_by_section(hits, "section").collect()}
    assert out == {"a": (0.575, 2), "b": (0.575, 3), "c": (0.6, 1)}
    ranked = lambda ids: spark.createDataFrame([(1, i, k) for k, i in enumerate(ids, 1)], "query_id long, doc_id string, rank long")
    fused = retrieval.rrf(ranked(["c1", "c2"]), ranked(["c3", "c1"]), 10).orderBy("rank").collect()
    assert fused[0].doc_id == "c1" and {r.doc_id for r in fused} == {"c1", "c2", "c3"} and fused[0].score > 1 / 61


def test_vector_blocks_and_nulls(spark):
    base = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)] + [(9, None)], "vec_id long, embedding array<float>")
    asked = base.where("vec_id < 4").select(F.col("vec_id").alias("query_id"), "embedding")
    whole = sorted(map(tuple, retrieval.vector_topk(base, asked, 3).collect()))
    keep, retrieval.MOST_QUERY_BYTES = retrieval.MOST_QUERY_BYTES, 16
    try:
        assert sorted(map(tuple, retrieval.vector_topk(base, asked, 3).collect())) == whole
    finally:
        retrieval.MOST_QUERY_BYTES = keep
    assert retrieval.vector_topk(base, asked.limit(0), 3).count() == 0


ELEMENT = "doc_id long, elem_idx long, text string, type string, page_numbers array<int>, section_title string, section_path string"


def elements(spark, rows):
    return spark.createDataFrame([(1, k, t, kind, [p], s, s) for k, (t, kind, p, s) in enumerate(rows)], ELEMENT)


def test_packers(spark):
    words = lambda n: "word " * n
    size = {"count": lambda t: len(t.split())}
    big = chunking.pack_elements(elements(spark, [(words(5), "text", 1, "1 A"), (words(60), "table", 2, "1 A"), (words(5), "text", 3, "1 A")]), "semantic", 50, 0, **size).orderBy("chunk_index").collect()
    assert [r.chunk_type for r in big] == ["text", "table", "text"] and big[1].page_numbers == [2]
    over = chunking.pack_elements(elements(spark, [(words(20), "text", k, "1 A") for k in range(1, 6)]), "semantic", 50, 20, **size).orderBy("chunk_index").collect()
    assert [r.n_tokens for r in over] == [40, 40, 40, 40] and over[0].page_numbers == [1, 2] and over[1].page_numbers == [3]
    aware = chunking.pack_elements(elements(spark, [(words(40), "text", 1, "6.6.34 A"), (words(40), "text", 2, "6.6.35 B")]), "section_aware", 100, 10, 30, 200, **size)
    assert aware.count() == 2
    small = chunking.pack_elements(elements(spark, [(words(5), "text", 1, "6.6 A"), (words(5), "text", 2, "6.7 B")]), "section_aware", 100, 10, 30, 200, **size)
    assert small.count() == 1
    named = chunking.pack_elements(elements(spark, [("6.6.1 One\n", "text", 1, "6.6.1 One"), ("x\n6.6.2 Two\ny", "text", 1, "6.6.2 Two")]), "hybrid", 100, 0, 50, 200, **size).first()
    assert named.section_title == "6.6 (Multiple subsections)"
    latest = chunking.pack_elements(elements(spark, [("6.6.1 One x", "text", 1, "6.6.1 One"), ("7.1 Two y", "list_item", 1, "7.1 Two"), (" ", "text", 9, None), (None, "text", 9, "z")]), "hybrid", 100, 0, 50, 200, **size).collect()
    assert [(r.section_title, r.chunk_type, r.page_numbers) for r in latest] == [("7.1 Two", "text", [1])]
    with pytest.raises(ValueError):
        chunking.create_chunker("other")


def test_fixed_windows_stop(spark):
    docs = spark.createDataFrame([(1, "w " * 120), (2, None), (3, "a b")], "doc_id long, text string")
    got = chunking.fixed_windows(docs, 50, 10).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(1, 50), (1, 50), (1, 40), (3, 2)]


def test_store(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id long, text string")
    own = store.ChunkStore(spark, str(tmp_path / "chunks"))
    own.replace_documents(chunks)
    own.replace_documents(spark.createDataFrame([(1, "new")], "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in own.read().collect()) == [(1, "new"), (2, "c")]
    own.delete(2)
    assert own.read(2).count() == 0 and own.read().count() == 1


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "w " * 120)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    ingest.write_chunks(ingest.chunk_stream(spark, str(tmp_path / "in"), "doc_id long, text string", 50, 10), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_entry_without_training_operators(tmp_path):
    """The driver may delete the training-data folder and the pipeline; the rest must import."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/textloom", tmp_path / "textloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_common_parent_reads_every_title(spark):
    group = F.concat(F.array_repeat(F.array(F.lit(3), F.lit(1), F.lit(2)), 10_001), F.array(F.array(F.lit(3), F.lit(4))))
    got = spark.range(1).select(T.common_parent(group).alias("p"), T.common_parent(F.slice(group, 1, 1)).alias("one")).first()
    assert (got.p, got.one) == ("3", "3.1.2")


def test_registry_and_ingest(spark, tmp_path):
    registry, chunks = store.Registry(spark, str(tmp_path / "r")), store.ChunkStore(spark, str(tmp_path / "c"))
    assert registry.documents().count() == 0 and registry.get("a").count() == 0
    rows = spark.createDataFrame([("a", "one"), ("a", "two")], "doc_id string, text string")
    for doc in ("a", "b"):
        store.ingest(registry, chunks, {"doc_id": doc, "title": doc, "protocol": "p"}, rows.withColumn("doc_id", F.lit(doc)))
    assert registry.get("a").first().total_chunks == 2 and chunks.read().count() == 4
    with pytest.raises(ValueError):
        store.ingest(registry, chunks, {"doc_id": "c"}, rows.limit(0))
    bad = {"doc_id": "c", "total_pages": "many"}
    with pytest.raises(Exception):
        store.ingest(registry, chunks, bad, rows.withColumn("doc_id", F.lit("c")))
    assert chunks.read("c").count() == 0 and registry.get("c").count() == 0  # what was written before the failure is gone
    with pytest.raises(Exception):  # and what a failed second version was to replace is there again
        store.ingest(registry, chunks, {"doc_id": "a", "title": "new", "total_pages": "many"}, rows.withColumn("text", F.lit("new")))
    assert sorted(r.text for r in chunks.read("a").collect()) == ["one", "two"] and registry.get("a").first().title == "a"
    with pytest.raises(KeyError):
        registry.soft_delete("nobody", chunks)
    registry.soft_delete("a", chunks)
    assert [r.doc_id for r in registry.documents().collect()] == ["b"] and not registry.get("a").first().is_active and chunks.read().count() == 2
    assert store.filtered(chunks.read(), registry.read(), protocol="p", active_only=True).count() == 2 and store.filtered(chunks.read(), doc_id="a").count() == 0
    chunks.vacuum()
    assert chunks.read("b").count() == 2 and chunks.info().first().n == 2


def test_upsert_ties_and_nulls(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b")], "k long, v string")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 1), (None, "z", None)], "k long, v string, seq long")
    assert sorted(map(tuple, store.upsert(old, new, "k").collect()), key=str) == sorted([(1, "y"), (None, "z")], key=str)
    assert store.upsert(old, new.limit(0), "k").count() == 2 and store.upsert(old.limit(0), new, "k").count() == 2


def test_answers_by_a_caller(spark):
    """A caller's answer cites hits; its failure says so at confidence 0; without hits nothing can be answered."""
    planned = answers.plan(spark.createDataFrame([(1, "how to reset"), (2, "boom"), (3, "nothing")], "query_id long, text string"), top_k=2, min_score=0.1, strategy="vector")
    chunks = spark.createDataFrame([(10, "first text", "A", [3, 4], "s"), (11, "second text", "A", [], "s"), (12, "third", "B", None, None)], "doc_id long, text string, section_path string, pages array<long>, source string")
    hits = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (1, 12, 0.7, 3), (2, 12, 0.5, 1), (3, 12, 0.05, 1)], "query_id long, doc_id long, score double, rank long")
    found = answers.retrieve(planned, hits, hits.limit(0), chunks)

    def generate(row):
        if row["query"] == "boom":
            raise OSError("no model")
        return f"See [2] and [1], not [7]. {row['instructions'][:4]}" if row["context"].startswith("[1]") else "I cannot answer this"

    got = {r.query_id: r for r in answers.answer(planned, found, generate).collect()}
    assert got[1].answer.endswith("Prov") and [(c.number, c.doc_id) for c in got[1].citations] == [(2, 11), (1, 10)] and got[1].confidence == 1.0
    assert got[1].top_score == pytest.approx(0.9 * 1.15) and got[1].num_chunks == 2 and got[1].query_type == "procedural"
    assert got[2].error == "OSError: no model" and got[2].confidence == 0 and got[2].answer.startswith(answers.FAILED) and got[2].citations == []
    assert got[3].confidence == 0 and got[3].num_chunks == 0 and got[3].context == answers.NO_CONTEXT
    shown = {r.query_id: r.shown for r in answers.formatted(answers.answer(planned, found, generate)).collect()}
    assert "**[2]** A  \n📄 Page N/A · Relevance: 92.0%" in shown[1] and "🟢 High Confidence (100.0%)" in shown[1] and "Sources" not in shown[3]
    assert answers.formatted(answers.answer(planned, found), "plain").where("query_id = 3").first().shown == answers.CANNOT
    checked = {r.query_id: r for r in answers.checked(answers.answer(planned, found)).collect()}
    assert checked[1].is_valid and checked[1].supported == 1.0 and not checked[3].is_valid
    simple = {r.query_id: r for r in answers.simple(planned, hits.where("score > 0.1").join(chunks.withColumn("section_title", F.col("section_path")), "doc_id")).collect()}
    assert simple[3].answer == answers.NO_RESULT and simple[1].citations[0].page == "3, 4" and simple[1].confidence == 0.9
    audit = store.audit_rows(answers.answer(planned, found, generate), "m", 30.0)
    assert audit.count() == 3 and {r.query_id: len(r.citations) for r in store.citations_of(audit).collect()} == {"1": 2, "2": 0, "3": 0}
    stats = store.pipeline_stats(audit).first()
    assert stats.total_queries == 3 and stats.by_model == {"m": 3} and store.pipeline_stats(audit.limit(0)).first().total_queries == 0


def test_a_model_is_called_once_a_question(spark, tmp_path):
    """A model that answers differently each time: the answer, its citations and its audit row come from one call."""
    planned = answers.plan(spark.createDataFrame([(k, f"q{k}") for k in range(5)], "query_id long, text string"), top_k=2, min_score=0.0, strategy="vector")
    hits = spark.createDataFrame([(k, d, 0.9 - d / 10, d) for k in range(5) for d in (1, 2)], "query_id long, doc_id long, score double, rank long")
    chunks = spark.createDataFrame([(1, "one", "A", [1]), (2, "two", "B", [2])], "doc_id long, text string, section_path string, pages array<long>")
    folder = str(tmp_path)

    def generate(row):
        name = f"{folder}/{row['query']}"
        with open(name, "a") as f:
            f.write("x")
        n = os.path.getsize(name)
        return {"answer": f"call {n} [{n}]", "model": "m1", "prompt_tokens": 7, "completion_tokens": n}

    out = answers.answer(planned, answers.retrieve(planned, hits, hits.limit(0), chunks), generate)
    rows = out.collect()
    audit = store.audit_rows(out, "none", 99.0)
    assert out.count() == audit.count() == 5 and answers.formatted(out).count() == 5
    assert {os.path.getsize(f"{folder}/q{k}") for k in range(5)} == {1}
    assert {(r.answer, r.citations[0].number, r.model, r.usage.completion_tokens, r.latency_ms >= 0) for r in rows} == {("call 1 [1]", 1, "m1", 1, True)}
    assert {(r.answer, r.model, '"number":1' in r.citations) for r in audit.collect()} == {("call 1 [1]", "m1", True)}


def test_numbers_of_any_length(spark):
    long = "9" * 25
    row = spark.range(1).select(T.citations(F.lit(f"[{long}] and [2], [{long}], [2]")).alias("c"), T.section_numbers(F.lit(f"{long}.1 X")).alias("s")).first()
    assert row.c == [2] and row.s == [1]
    pages = spark.createDataFrame([(1, 1, f"1.2 Title of it ..... {long}\n1.3 Another one ..... 12")], "spec_id long, page_no int, text string")
    assert {(r.section_number, r.page_number) for r in toc.entries(pages).collect()} == {("1.3", 12)}


def test_context_of_null_fields(spark):
    hits = spark.createDataFrame([(1, 1, None, [3], 0.5, "aa"), (1, 2, "P", None, None, None), (1, 3, "Q", [], 0.25, "bb")], "query_id long, rank long, section_path string, pages array<int>, score double, text string")
    got = retrieval.context(hits).first().context
    assert got == "[1]  (Page 3, Relevance: 50.0%)\naa\n\n---\n\n[2] P (Page N/A, Relevance: 0.0%)\n\n\n---\n\n[3] Q (Page N/A, Relevance: 25.0%)\nbb\n"


def test_best_of_many_queries_in_bounded_steps(spark, monkeypatch):
    """Ties, more queries than a step's scores and batches smaller than k: the rows of a plain sort."""
    import numpy as np

    rng = np.random.default_rng(5)
    base, asked = rng.integers(-2, 3, (300, 4)).astype(float), rng.integers(-2, 3, (90, 4)).astype(float)
    monkeypatch.setattr(retrieval, "MOST_SCORES", 500)
    best = retrieval.Best(90, 7)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    score = np.round(unit(asked) @ unit(base).T, 6)
    ids = rng.permutation(300)
    for a in range(0, 300, 5):
        for q in range(0, 90, 40):
            best.add(q, score[q : q + 40, a : a + 5], ids[a : a + 5])
    got = sorted((int(q), int(i), float(x)) for part in best.rows(50) for q, i, x in zip(*part))
    want = sorted((q, int(ids[j]), float(score[q, j])) for q in range(90) for j in sorted(range(300), key=lambda j: (-score[q, j], ids[j]))[:7])
    assert got == want
    frame = lambda m, *names: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], f"{names[0]} long, embedding array<double>")
    rows = retrieval.vector_topk(frame(base, "vec_id"), frame(asked, "query_id"), 7).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in rows) == sorted((q, j, float(score[q, j]) + 0.0) for q in range(90) for j in sorted(range(300), key=lambda j: (-score[q, j], j))[:7])


def test_simple_chunks_are_windows(spark):
    from textloom import cli
    from textloom.config import Settings

    words = " ".join(f"w{k}" for k in range(12))
    got = cli.chunked(elements(spark, [(words, "text", 1, None)]), Settings(chunking_strategy="simple", chunk_size=8, chunk_overlap=2)).orderBy("chunk_index").collect()
    assert [r.text for r in got] == [" ".join(f"w{k}" for k in range(8)), " ".join(f"w{k}" for k in range(6, 12))] and got[0].section_path is None


def test_correction_and_validation_by_a_caller(spark):
    rows = spark.createDataFrame([(1, "good text", "Some title", "p"), (2, "body", "Figure 2", "p"), (3, None, None, None), (4, "raise", "Ab", "p")], "chunk_id long, text string, section_title string, section_path string")

    def corrector(row):
        if row["text"] == "raise":
            raise ValueError("down")
        return {"section_title": "Fixed", "confidence": 0.9} if row["text"] else {}

    done = sections.correct(rows, corrector)
    got = {r.chunk_id: (r.section_title, r.section_path, r.correction_confidence, r.correction_error) for r in done.collect()}
    assert got == {1: ("Some title", "p", None, None), 2: ("Fixed", "p", 0.9, None), 3: (None, None, 0.5, None), 4: ("Ab", "p", 0.0, "ValueError: down")}
    assert tuple(sections.correction_stats(done).first()) == (4, 2, 1, 1)
    checked = sections.assure(rows, corrector, lambda r: {"is_match": r["text"] == "body", "relevance_score": 0.9, "expected_section": "Expected" if r["text"] else None})
    got = {r.chunk_id: (r.section_title, r.needs_review, r.auto_fixed, r.needs_manual_review) for r in checked.collect()}
    assert got == {1: ("Expected", True, True, False), 2: ("Fixed", False, False, False), 3: (None, True, False, True), 4: ("Expected", True, True, False)}
    bad = sections.validate(rows, lambda r: 1 / 0)
    assert tuple(sections.validation_stats(bad).first()) == (4, 4, 0, 0, 4, 4) and sections.low_relevance(bad, 2).count() == 2
    assert sections.correct(rows.limit(0), corrector).count() == 0


def test_validated_headings(spark):
    rows = [("heading", "Chapter 6 Functions"), ("text", "a"), ("heading", "Figure 3"), ("text", "b"), ("heading", "6.6 Bus"), ("heading", "B.2 Queue"), ("text", "c")]
    e = spark.createDataFrame([(1, k, kind, t) for k, (kind, t) in enumerate(rows)] + [(None, 0, "text", "z")], "doc_id long, elem_idx long, type string, text string")
    got = [(r.section_title, r.section_path) for r in tables.with_sections(e, validated=True).where("doc_id = 1").orderBy("elem_idx").collect()]
    assert got[1] == ("Chapter 6 Functions", "Chapter 6 Functions") and got[3] == got[1] and got[5] == ("6.6 Bus", "6.6 Bus") and got[6] == ("B.2 Queue", "6.6 Bus > B.2 Queue")
    assert got[0] == (None, None) and tables.with_sections(e.limit(0)).count() == 0


def test_vectors_of_odd_shapes(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, []), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [0.0, 0.0])], "vec_id long, embedding array<double>")
    asked = base.where("vec_id <> 7").select(F.col("vec_id").alias("query_id"), "embedding")
    assert sorted((r.query_id, r.vec_id, r.score) for r in retrieval.vector_topk(base, asked, 5).collect()) == [(1, 1, 1.0), (1, 7, 0.0), (2, 2, 1.0)]


def test_command_line(spark, tmp_path, capsys):
    from textloom import cli

    (tmp_path / "book.txt").write_text("The reset command stops the card.\n\nSecond paragraph\fPage two talks of voltage")
    root = f"file://{tmp_path}/root"
    assert cli.main(["--root", root, "ingest", str(tmp_path / "book.txt"), "--protocol", "mmc", "--version", "5.1", "--title", "Book"]) == 0
    assert cli.main(["--root", root, "list"]) == 0
    line = capsys.readouterr().out
    assert line.startswith("mmc             5.1        Book") and " 2        1        " in line
    assert cli.main(["--root", root, "ask", "what about voltage"]) == 0
    assert "[1]" in capsys.readouterr().out
    doc = store.Registry(spark, f"{root}/registry").documents().first().doc_id
    assert cli.main(["--root", root, "delete", doc]) == 0 and cli.main(["--root", root, "list"]) == 0 and capsys.readouterr().out == ""


def test_empty_tables_and_nulls(spark):
    """Operators over nothing give nothing; null texts are no text."""
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.text for r in chunking.split_long(docs).collect()] == [""] and chunking.split_long(docs.limit(0)).count() == 0
    hits = spark.createDataFrame([], "query_id long, doc_id long, rank long, section string, score double")
    assert retrieval.rrf(hits, hits, 5).count() == 0 and retrieval.rerank_by_section(hits, "section").count() == 0
    pages = spark.createDataFrame([], "spec_id long, page_no long, text string")
    assert toc.chunk_document(pages).count() == 0 and toc.headed_coverage(pages).count() == 0 and toc.unheaded_pages(pages).count() == 0
    assert chunking.pack_elements(spark.createDataFrame([], ELEMENT)).count() == 0
    assert chunking.create_chunker("simple", size=5, overlap=1)(elements(spark, [("a b c", "text", 1, None), ("d e f", "text", 1, None)])).count() == 2


def test_index_of_nothing_and_pages_of_files(spark, tmp_path):
    empty = retrieval.Bm25Index.build(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/i")
    assert retrieval.bm25(empty, spark.createDataFrame([(1, "a b")], "query_id long, text string")).count() == 0
    (tmp_path / "a.txt").write_text("one\ftwo\f")
    got = tables.pages_from_binaries(spark, str(tmp_path / "a.txt"), lambda raw: raw.decode().split("\f"), "*")
    assert sorted((r.page_no, r.text) for r in got.collect()) == [(1, "one"), (2, "two")]
    store.write_report(got.select("text"), f"file://{tmp_path}/report", "text")
    assert spark.read.text(f"file://{tmp_path}/report").count() == 2


def test_token_counter_by_vocabulary():
    import public_tokenizers

    assert chunking.bpe_count(public_tokenizers.path("byte_bpe_50k.json"))("hello world") == 2


def test_an_element_ends_with_its_own_tag(spark):
    html = "<table><tr><td><p>a</p></td><td><p>b</p></td></tr></table><li><p>c</p> d</li><p>e<p>f</p><pre>g</pre><h1>x</h2>y</h1>"
    got = tables.html_elements(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert [(r.type, r.text) for r in got] == [("table", "ab"), ("list_item", "c d"), ("text", "ef"), ("heading", "xy")]
