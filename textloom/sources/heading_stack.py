"""The stack of headings above each element, worked out block by block, so that one very long document spreads over tasks.

What a block of elements does to the stack is a function of the stack it meets: a heading of level n keeps the n - 1 entries below it and adds itself. Such a function is known by
what it does to stacks of 0, 1, ... ``DEPTH`` entries: it keeps so many of them and adds a list of its own. These functions compose, so the blocks of a document are summed up side by side,
their few summaries are composed in order, and each block is then worked through from the stack it really meets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

DEPTH = 5
BLOCK_ROWS = 2_000


def push(path: list[str], n: int, text: str) -> list[str]:
    """The stack after a heading of level ``n``."""
    return [*path[: n - 1], text]


def summary(headings: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """For a stack of each depth: how many of its entries the headings keep, and what they add."""
    out = []
    for depth in range(DEPTH + 1):
        kept, own = depth, []
        for n, text in headings:
            if n - 1 <= kept:
                kept, own = n - 1, [text]
            else:
                own = [*own[: n - 1 - kept], text]
        out.append((kept, own))
    return out


def meet(path: list[str], block: list) -> list[str]:
    kept, own = block[len(path)]
    return [*path[:kept], *own]


def _blocks(rows: int):
    """Rows in order -> blocks: the rows as an Arrow stream, and what the block's first and last documents do to their stacks."""

    def close(held: list[pa.RecordBatch], seq: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        docs, level, text = (table.column(c).to_pylist() for c in ("doc_id", "_level", "text"))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        n = len(docs)
        own = lambda a, b: [(level[k], text[k]) for k in range(a, b) if level[k] is not None]
        end = next((k for k in range(1, n) if docs[k] != docs[0]), n)
        last = next((k for k in range(n - 1, 0, -1) if docs[k - 1] != docs[n - 1]), 0)
        tell = lambda heads: json.dumps([summary(heads), heads[-1][1] if heads else None])
        keys = pa.array([docs[0], docs[-1]], table.schema.field("doc_id").type)
        names = ["part", "seq", "first", "last", "head", "tail", "rows"]
        tail = tell(own(last, n)) if end < n else None
        return pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([seq], pa.int32()), keys[:1], keys[1:], pa.array([tell(own(0, end))]), pa.array([tail], pa.string()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seq = [], 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                piece = batch.slice(a, rows)
                if n and n + piece.num_rows > rows:
                    yield close(held, seq)
                    held, n, seq = [], 0, seq + 1
                held.append(piece)
                n += piece.num_rows
        if n:
            yield close(held, seq)

    return run


def _compose(told: pd.DataFrame) -> pd.DataFrame:
    """A document's blocks in order -> the stack and the title that each meets; the block in which it begins after another one starts with that other one's."""
    out, path, title = [], [], None
    for part, seq, head, said in told.sort_values(["part", "seq"])[["part", "seq", "head", "said"]].itertuples(index=False):
        if head:
            out.append((part, seq, json.dumps([path, title])))
        moves, last = json.loads(said)
        path, title = meet(path, moves), title if last is None else last
    return pd.DataFrame(out, columns=["part", "seq", "start"])


def spread_sections(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows(doc_id, elem_idx, text, _level, ...)`` with ``section_title`` and ``section_path``, as ``tables.with_sections`` gives them. ``_level`` is that of a heading, at most ``DEPTH``.

    Rows go by range of (doc_id, elem_idx, text) to ``spark.sql.shuffle.partitions`` tasks and are written in blocks once; a task holds a block.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc = rows.schema["doc_id"].dataType.simpleString()
    in_order = rows.repartitionByRange(n, "doc_id", "elem_idx", "text").sortWithinPartitions("doc_id", "elem_idx", "text")
    blocks = written(in_order.mapInArrow(_blocks(block_rows), f"part int, seq int, first {doc}, last {doc}, head string, tail string, rows binary"), "blocks")
    ends = blocks.select(F.explode(F.array(F.struct(F.col("first").alias("doc"), "part", "seq", F.lit(True).alias("head"), F.col("head").alias("said")), F.when(F.col("tail").isNotNull(), F.struct(F.col("last").alias("doc"), "part", "seq", F.lit(False).alias("head"), F.col("tail").alias("said"))))).alias("e"))
    ends = ends.where("e is not null").select("e.*")
    several = ends.groupBy("doc").count().where("count > 1").select(F.col("doc").alias("of"))
    told = ends.join(several, F.col("doc").eqNullSafe(F.col("of")), "left_semi")
    starts = told.groupBy("doc").applyInPandas(_compose, "part int, seq int, start string")
    schema = rows.schema
    out = rows.select(*rows.columns, F.lit(None).cast("string").alias("section_title"), F.lit(None).cast("string").alias("section_path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, start in zip(batch.column("rows").to_pylist(), batch.column("start").to_pylist()):
                table = pa.ipc.open_stream(raw).read_all()
                path, title = json.loads(start) if start else ([], None)
                docs, titles, paths, now = table.column("doc_id").to_pylist(), [], [], None
                for k, (d, level, text) in enumerate(zip(docs, table.column("_level").to_pylist(), table.column("text").to_pylist())):
                    if k and d != now:
                        path, title = [], None
                    now = d
                    titles.append(title)
                    paths.append(" > ".join(path) if path else None)
                    if level is not None:
                        path, title = push(path, level, text), text
                table = table.append_column("section_title", pa.array(titles, pa.string())).append_column("section_path", pa.array(paths, pa.string()))
                yield from table.combine_chunks().to_batches()

    return blocks.select("part", "seq", "rows").join(starts, ["part", "seq"], "left").mapInArrow(run, out.schema)
