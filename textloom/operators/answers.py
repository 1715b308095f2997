"""Questions to cited answers, a batch at a time: route, retrieve, re-rank, assemble context, answer, cite, and say how sure."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from . import retrieval, store
from .plugs import with_results

# What is said where nothing is found, and the instructions for each type of question.
NO_CONTEXT = "No relevant context found."
NO_RESULT = "I couldn't find any relevant information. Please try rephrasing your question."
CANNOT = "I cannot answer this based on the provided context"
FAILED = "I encountered an error while processing your question: "
INSTRUCTIONS = {
    "definition": "Provide a clear, concise definition. Include the official specification definition if available.",
    "factual": "Provide factual information directly from the specification. Be precise and technical.",
    "comparison": "Create a detailed comparison table or structured comparison. Highlight key differences.",
    "procedural": "Provide step-by-step instructions in a numbered list. Include prerequisites and post-conditions.",
    "specification": "Provide exact specification values (timing, voltage, frequency, etc.). Include units and conditions.",
    "troubleshooting": "Identify potential causes and solutions. Reference specification requirements that may be violated.",
}
ANY_INSTRUCTION = "Provide a detailed, technical answer."


def instructions(query_type) -> Column:
    out = F.lit(ANY_INSTRUCTION)
    for kind, text in INSTRUCTIONS.items():
        out = F.when(F.col(query_type) == kind, text).otherwise(out)
    return out


def entities(text) -> Column:
    """Distinct capitalised words of four letters or more, sorted: a stand-in for a model's entities."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[A-Z][a-z]{3,}"), F.lit(0))))


def found_entities(rows: DataFrame, find: Callable[[dict], list] | None = None) -> DataFrame:
    """Rows with ``entities``, sorted and distinct: what ``find`` names in a row, or ``entities`` of its text. Where it fails there are none, and ``entities_error`` says why."""
    if find is None:
        return rows.withColumns({"entities": entities("text"), "entities_error": F.lit(None).cast("string")})
    out = with_results(rows, lambda r: {"names": [str(x) for x in find(r)]}, "names array<string>", "_found")
    return out.withColumn("entities", F.array_sort(F.array_distinct(F.coalesce("_found.names", F.array().cast("array<string>"))))).withColumnRenamed("_found_error", "entities_error").drop("_found")


def plan(queries: DataFrame, top_k: int | None = None, min_score: float | None = None, strategy: str | None = None, classifier: Callable[[dict], str] | None = None) -> DataFrame:
    """``queries(query_id, text)`` with ``query_type``, ``strategy``, ``top_k`` and ``min_score``: the router's, or the caller's where given.
    Types and strategies that are not known fall back to vectors."""
    routed = retrieval.route(queries, classifier)
    pick = lambda given, column: F.col(column) if given is None else F.lit(given)
    return routed.select(
        "query_id", "text", "query_type", F.when(pick(strategy, "strategy") == "hybrid", "hybrid").otherwise("vector").alias("strategy"),
        F.coalesce(pick(top_k, "top_k"), F.lit(10)).cast("long").alias("top_k"), pick(min_score, "min_score").cast("double").alias("min_score"),
    )


def retrieve(planned: DataFrame, vector: DataFrame, keyword: DataFrame, chunks: DataFrame, rerank: bool = True) -> DataFrame:
    """``planned`` queries, ``vector`` and ``keyword`` hits ``(query_id, doc_id, score, rank)`` at least ``2 * top_k`` deep, ``chunks(doc_id, text, section_path, pages, ...)`` ->
    hits ``(query_id, rank, score, doc_id, ...)``.

    The least score applies to the vector hits, after the cut; hybrid queries fuse twice ``top_k`` hits of each list. More than one hit is re-ranked by its section's
    share of the hits; chunks missing from ``chunks`` drop out.
    """
    asked = planned.select("query_id", "strategy", "top_k", "min_score")
    hybrid = F.col("strategy") == "hybrid"
    deep = F.when(hybrid, 2 * F.col("top_k")).otherwise(F.col("top_k"))
    found = vector.join(asked, "query_id").where((F.col("rank") <= deep) & (F.col("min_score").isNull() | (F.col("score") >= F.col("min_score"))))
    words = keyword.join(asked.where(hybrid), "query_id").where(F.col("rank") <= 2 * F.col("top_k"))
    most = planned.agg(F.max("top_k")).first()[0] or 0
    fused = retrieval.rrf(found.where(hybrid).select("query_id", "doc_id", "rank"), words.select("query_id", "doc_id", "rank"), most)
    fused = fused.join(asked.select("query_id", "top_k"), "query_id").where("rank <= top_k").select("query_id", "doc_id", "score", "rank")
    hits = retrieval.small(written(found.where(~hybrid).select("query_id", "doc_id", "score", "rank").unionByName(fused), "hits"))
    hits = chunks.join(hits, "doc_id")  # chunks stay where they are read, unless there are many hits
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id")).cast("long"))
    if rerank:
        several = F.count("*").over(Window.partitionBy("query_id")) > 1
        hits = retrieval.rerank_by_section(hits, "section_path").withColumn("score", F.when(several, F.col("new_score")).otherwise(F.col("score"))).withColumn("rank", F.col("new_rank"))
        hits = hits.drop("new_score", "new_rank")
    return hits


def search(planned: DataFrame, asked: DataFrame, chunks: DataFrame, index: retrieval.Bm25Index, registry: DataFrame | None = None, doc_id=None, protocol: str | None = None, active_only: bool = False, deep: int = 30, rerank: bool = True) -> DataFrame:
    """Retrieve among the chunks of a document, of a protocol or of active documents.

    ``asked(query_id, embedding)``, ``chunks(chunk_id, doc_id, embedding, text, section_path, pages, ...)``, ``index`` over chunk ids. Filters hold before the cut on the vector side,
    and on the keyword side after the scores, so that a word's weight stays that of the whole corpus.
    """
    own = store.filtered(chunks, registry, doc_id, protocol, active_only)
    vector = retrieval.vector_topk(own, asked, deep, "chunk_id").withColumnRenamed("chunk_id", "doc_id")
    keyword = retrieval.bm25_topk(index, planned, deep, own.select(F.col("chunk_id").alias("doc_id")))
    payload = own.withColumn("of_doc", F.col("doc_id")).drop("doc_id", "embedding").withColumnRenamed("chunk_id", "doc_id")
    return retrieve(planned, vector, keyword, payload, rerank)


def extract(hits: DataFrame, most: int = 3, chars: int = 160) -> DataFrame:
    """``(query_id, answer)``: the opening of the best hits, each with its number: a stand-in for a model's answer."""
    part = F.concat(F.trim(F.substring(F.coalesce("text", F.lit("")), 1, chars)), F.lit(" ["), F.col("rank").cast("string"), F.lit("]"))
    own = hits.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("p"))
    return own.select("query_id", F.array_join(F.transform("p", lambda x: x["part"]), " ").alias("answer"))


#: What a model's call may tell beside its answer.
SAID = "answer string, model string, prompt_tokens long, completion_tokens long, latency_ms double"


def _timed(generate: Callable[[dict], str | dict]) -> Callable[[dict], dict]:
    def call(row: dict) -> dict:
        began = time.perf_counter()
        said = generate(row)
        return {**(said if isinstance(said, dict) else {"answer": said}), "latency_ms": 1000 * (time.perf_counter() - began)}

    return call


def answer(planned: DataFrame, hits: DataFrame, generate: Callable[[dict], str | dict] | None = None, context_chars: int = 4000, context_hits: int = 5) -> DataFrame:
    """``(query_id, query, query_type, strategy, answer, citations, confidence, num_chunks, num_citations, top_score, context, error, model, usage, latency_ms)``, a row per query.

    ``generate`` gets ``query``, ``context``, ``instructions`` and ``query_type`` and gives the answer's text, in which ``[n]`` cites hit n, or a dict of ``answer`` and what it knows of ``model``,
    ``prompt_tokens`` and ``completion_tokens``. It is called once a question: what it said is written down before anything is read from it. If it raises, the answer says so, cites
    nothing and has confidence 0. Without it, or without hits, the answer is extracted. Citations beyond the hits are dropped.
    """
    hits = written(hits, "found")
    top = hits.groupBy("query_id").agg(F.count("*").alias("num_chunks"), F.max_by("score", -F.col("rank")).alias("top_score"))
    rows = planned.select("query_id", F.col("text").alias("query"), "query_type", "strategy").join(top, "query_id", "left").join(retrieval.context(hits, context_chars, context_hits), "query_id", "left")
    rows = rows.join(extract(hits), "query_id", "left").withColumns({"context": F.coalesce("context", F.lit(NO_CONTEXT)), "answer": F.coalesce("answer", F.lit(CANNOT)), "error": F.lit(None).cast("string")})
    if generate is not None:
        rows = written(with_results(rows.withColumn("instructions", instructions("query_type")), _timed(generate), SAID, "_g"), "answers")
        rows = rows.withColumn("answer", F.when(F.col("_g_error").isNull(), F.coalesce("_g.answer", F.lit(""))).otherwise(F.concat(F.lit(FAILED), F.col("_g_error")))).withColumn("error", F.col("_g_error"))
        rows = rows.withColumns({"model": F.col("_g.model"), "usage": F.struct("_g.prompt_tokens", "_g.completion_tokens"), "latency_ms": F.col("_g.latency_ms")})
    else:
        none = lambda kind: F.lit(None).cast(kind)
        rows = rows.withColumns({"model": none("string"), "usage": none("struct<prompt_tokens:bigint,completion_tokens:bigint>"), "latency_ms": none("double")})
    good = F.col("error").isNull()
    cited = rows.where(good).select("query_id", F.posexplode(T.citations("answer")).alias("pos", "number"))
    cited = cited.join(hits.withColumn("number", F.col("rank")), ["query_id", "number"])
    one = F.struct("pos", "number", "doc_id", "section_path", "pages", "score", T.preview("text").alias("text_preview"))
    cited = cited.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda c: c.dropFields("pos")).alias("citations"))
    out = rows.join(cited, "query_id", "left").withColumn("citations", F.coalesce("citations", F.array()))
    sure = F.when(good, T.confidence("top_score", "answer")).otherwise(0.0)
    return out.select(
        "query_id", "query", "query_type", "strategy", "answer", "citations", sure.alias("confidence"), F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"),
        F.size("citations").cast("long").alias("num_citations"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"), "context", "error", "model", "usage", "latency_ms",
    )


def bucket(confidence) -> Column:
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(c >= 0.8, "high").when(c >= 0.6, "medium").otherwise("low")


def formatted(answers: DataFrame, kind: str = "markdown") -> DataFrame:
    """``(query_id, shown)``: the answer with its confidence and sources as Markdown (``html`` likewise), or alone."""
    if kind not in ("markdown", "html"):
        return answers.select("query_id", F.col("answer").alias("shown"))
    mark = F.when(bucket("confidence") == "high", "🟢 High Confidence").when(bucket("confidence") == "medium", "🟡 Medium Confidence").otherwise("🔴 Low Confidence")
    percent = lambda c: F.format_string("%.1f%%", c * 100)
    line = lambda c: F.concat(F.lit("**["), c["number"].cast("string"), F.lit("]** "), F.coalesce(c["section_path"], F.lit("")), F.lit("  \n📄 Page "), T.page_list(c["pages"]), F.lit(" · Relevance: "), percent(c["score"]), F.lit("\n"))
    sources = F.when(F.size("citations") > 0, F.concat(F.lit("\n\n---\n\n## 📚 Sources\n"), F.array_join(F.transform("citations", line), ""))).otherwise("")
    return answers.select("query_id", F.concat("answer", F.lit("\n\n**Confidence:** "), mark, F.lit(" ("), percent(F.col("confidence")), F.lit(")"), sources).alias("shown"))


def checked(answers: DataFrame) -> DataFrame:
    """``(query_id, supported, is_valid)``: the share of the answer's distinct words that its context has; half of them must be."""
    words = F.array_distinct(T.tokens(F.regexp_replace("answer", r"\[\d+\]", "")))
    share = F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(words, T.tokens("context"))), F.size(words)), F.lit(0.0)), 6)
    return answers.select("query_id", share.alias("supported"), (share >= 0.5).alias("is_valid"))


def simple(planned: DataFrame, hits: DataFrame) -> DataFrame:
    """Answers without a model: ``(query_id, answer, citations, confidence)`` from the vector hits ``(query_id, rank, score, text, section_title, pages, source)`` as they are."""
    hits = written(hits, "found")
    best = hits.where("rank = 1").select("query_id", F.col("score").alias("confidence"), F.col("text").alias("top"), F.coalesce("section_title", F.lit("N/A")).alias("title"))
    text = F.concat(
        F.lit("**Relevant Information:**\n\n"), F.substring("top", 1, 800), F.lit("...\n\n*This is a simple retrieval result. Enable LLM mode for comprehensive answers with citations.*\n\n**Top Match:** "),
        F.col("title"), F.lit(" (Confidence: "), F.format_string("%.2f%%", F.col("confidence") * 100), F.lit(")\n"),
    )
    one = F.struct("rank", "source", F.coalesce("section_title", F.lit("N/A")).alias("section"), T.page_list("pages").alias("page"), T.preview("text", 300).alias("text"), F.col("score").alias("confidence"))
    cited = hits.where("rank <= 5").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda c: c.dropFields("rank")).alias("citations"))
    out = planned.select("query_id").join(best, "query_id", "left").join(cited, "query_id", "left")
    return out.select("query_id", F.coalesce(text, F.lit(NO_RESULT)).alias("answer"), F.coalesce("citations", F.array()).alias("citations"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
