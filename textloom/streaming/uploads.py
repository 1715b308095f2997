"""Uploads as a stateful stream: what is sent again is told by its content's hash, and a batch is written once however often it is run.

State, by document: the hash of the text that was last taken, and its version. A row of the same hash gives nothing; another text gives the document's next version.
Each micro-batch writes its chunks to a folder named by the batch's id, replacing what an earlier run of that batch has left there; readers take each
document's newest version, so a new version replaces the former chunks as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.chunking import fixed_windows

_TAKEN = "doc_id string, version long, text string"
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class Versions(StatefulProcessor):
    """The last taken hash and version of a document; of several rows in a batch the last by ``seq`` (null first), then by hash, counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            for seq, hash_, text in zip(part["seq"].tolist(), part["hash"].tolist(), part["text"].tolist()):
                rank = (seq == seq and seq is not None, seq if seq == seq and seq is not None else 0, hash_)
                if best is None or rank > best[0]:
                    best = rank, hash_, text
        held = self.last.get()
        if held is None or held[0] != best[1]:
            version = 1 if held is None else held[1] + 1
            self.last.update((best[1], version))
            yield pd.DataFrame({"doc_id": [key[0]], "version": [version], "text": [best[2]]})

    def close(self) -> None:
        pass


def new_versions(docs: DataFrame) -> DataFrame:
    """A stream ``docs(doc_id, text, seq)`` -> ``(doc_id, version, text)`` of new and changed documents. Null texts count as empty; a null doc_id is a document like others."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("seq").cast("double").alias("seq"))
    rows = rows.withColumn("hash", F.sha2("text", 256))
    return rows.groupBy("doc_id").transformWithStateInPandas(Versions(), outputStructType=_TAKEN, outputMode="Append", timeMode="None")


def start(spark: SparkSession, landing: str, path: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame] = fixed_windows) -> StreamingQuery:
    """Take all Parquet files of ``doc_id, text, seq`` that have landed, and end. ``chunk`` turns ``(doc_id, version, text)`` into chunks by ``doc_id``.

    A document without chunks still replaces its former version.
    """
    for k, v in _CONF.items():
        spark.conf.set(k, v)

    def write(batch: DataFrame, batch_id: int) -> None:
        taken = batch.persist()
        try:
            of = taken.select(F.col("doc_id").alias("taken_id"), "version")
            chunks = chunk(taken.select("doc_id", "text")).join(of, F.col("doc_id").eqNullSafe(F.col("taken_id"))).drop("taken_id")
            chunks.write.mode("overwrite").parquet(f"{path}/chunks/batch={batch_id}")
            taken.select("doc_id", "version").write.mode("overwrite").parquet(f"{path}/versions/batch={batch_id}")
        finally:
            taken.unpersist()

    docs = spark.readStream.schema("doc_id string, text string, seq long").parquet(landing)
    return new_versions(docs).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of each document's newest version."""
    newest = spark.read.parquet(f"{path}/versions").groupBy(F.col("doc_id").alias("of")).agg(F.max("version").alias("newest"))
    return spark.read.parquet(f"{path}/chunks").drop("batch").join(newest, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("newest")), "left_semi")
