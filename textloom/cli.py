"""``python -m textloom.cli``: ingest text files (pages apart by form feeds), list and delete documents, ask a question."""

from __future__ import annotations

import argparse
import time
from datetime import UTC, datetime

from pyspark.sql import functions as F

from .config import Settings
from .functions import text as T
from .log import set_up
from .operators import answers, chunking, retrieval, store
from .session import get_session, shared_folder, written
from .sources.tables import pages_from_binaries


def text_pages(raw: bytes) -> list[str]:
    return raw.decode(errors="replace").split("\f")


def ingest(spark, settings: Settings, root: str, path: str, protocol: str, version: str, title: str | None, parse=text_pages) -> list[str]:
    """Each file's pages become elements, packed by the settings' strategy; returns the documents' ids."""
    registry, chunks = store.Registry(spark, f"{root}/registry"), store.ChunkStore(spark, f"{root}/chunks")
    pages = pages_from_binaries(spark, path, parse, "*").select("doc_id", "page_no", "text")
    found = []
    for row in pages.groupBy("doc_id").agg(F.max("page_no").alias("n"), F.min_by("text", "page_no").alias("first")).collect():  # the files named on the command line
        doc_id = spark.range(1).select(T.document_id(F.lit(protocol), F.lit(version), F.lit(row.doc_id))).first()[0]
        own = pages.where(F.col("doc_id") == row.doc_id).select(F.lit(0).alias("doc_id"), F.posexplode(F.split("text", "\n\n")).alias("pos", "text"), "page_no")
        own = own.select("doc_id", (F.col("page_no") * 1_000_000 + F.col("pos")).alias("elem_idx"), "text", F.lit("text").alias("type"), F.array(F.col("page_no").cast("int")).alias("page_numbers"), F.lit(title).alias("section_title"), F.lit(title).alias("section_path"))
        packed = chunked(own, settings)
        packed = store.new_ids(packed.withColumn("doc_id", F.lit(doc_id)), "doc_id", "chunk_index")
        doc = {"doc_id": doc_id, "title": title or path.rsplit("/", 1)[-1], "protocol": protocol, "version": version, "file_path": path, "uploaded_at": datetime.now(UTC), "total_pages": row.n}
        store.ingest(registry, chunks, doc, store.with_vectors(packed, lambda c: retrieval.hashed_vector(c, settings.embedding_dim)))
        found.append(doc_id)
    return found


def chunked(elements, settings: Settings):
    """Elements packed by the settings' strategy; ``simple`` cuts a document's words into windows, and knows no sections or pages."""
    if settings.chunking_strategy != "simple":
        return chunking.pack_elements(elements, settings.chunking_strategy, settings.chunk_size, settings.chunk_overlap, settings.min_chunk_size, settings.max_chunk_size)
    none = lambda kind: F.lit(None).cast(kind)
    windows = chunking.create_chunker("simple", size=settings.chunk_size, overlap=settings.chunk_overlap)(elements)
    return windows.select("doc_id", "chunk_index", "text", "n_tokens", none("array<int>").alias("page_numbers"), F.lit("text").alias("chunk_type"), none("string").alias("section_title"), none("string").alias("section_path"))


def ask(spark, settings: Settings, root: str, question: str, generate=None, doc_id: str | None = None, protocol: str | None = None) -> dict:
    """The answer to a question over the chunks of active documents, or of one document or protocol, and an audit row of it."""
    began = time.time()
    rows = store.ChunkStore(spark, f"{root}/chunks").read()
    rows = rows.select(F.xxhash64("chunk_id").alias("chunk_id"), "doc_id", "embedding", "text", F.coalesce("section_path", F.lit("")).alias("section_path"), F.col("page_numbers").alias("pages"))
    planned = answers.plan(spark.createDataFrame([(0, question)], "query_id long, text string"), top_k=settings.top_k)
    asked = planned.select("query_id", retrieval.hashed_vector("text", settings.embedding_dim).alias("embedding"))
    index = retrieval.Bm25Index.build(rows.select(F.col("chunk_id").alias("doc_id"), "text"), f"{shared_folder(spark)}/textloom/cli-index")
    registry = store.Registry(spark, f"{root}/registry").documents(active_only=False)
    hits = answers.search(planned, asked, rows, index, registry, doc_id, protocol, active_only=True, deep=4 * settings.top_k)
    said = written(answers.answer(planned, hits, generate, settings.context_chars, settings.context_hits), "said")
    store.append_audit(store.audit_rows(said, "extractive", 1000 * (time.time() - began)), f"{root}/audit")
    return said.first().asDict(recursive=True)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textloom")
    parser.add_argument("--root", required=True, help="folder of the chunk, registry and audit tables")
    does = parser.add_subparsers(dest="does", required=True)
    new = does.add_parser("ingest")
    new.add_argument("path")
    new.add_argument("--protocol", required=True)
    new.add_argument("--version", required=True)
    new.add_argument("--title")
    does.add_parser("list")
    does.add_parser("delete").add_argument("doc_id")
    new = does.add_parser("ask")
    new.add_argument("question")
    new.add_argument("--doc-id")
    new.add_argument("--protocol")
    args = parser.parse_args(argv)
    spark, settings, log = get_session(), Settings.from_env(), set_up()
    registry = store.Registry(spark, f"{args.root}/registry")
    if args.does == "ingest":
        for doc_id in ingest(spark, settings, args.root, args.path, args.protocol, args.version, args.title):
            log.info("ingested %s", doc_id)
    elif args.does == "list":
        for r in store.document_table(registry.documents()).orderBy("doc_id").toLocalIterator():
            print(r.line)
    elif args.does == "delete":
        try:
            registry.soft_delete(args.doc_id, store.ChunkStore(spark, f"{args.root}/chunks"))
        except KeyError as e:
            log.error("%s", e.args[0])
            return 1
    else:
        print(ask(spark, settings, args.root, args.question, doc_id=args.doc_id, protocol=args.protocol)["answer"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
