"""Streaming counterparts: files that arrive are chunked and appended; audit rows are windowed with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import fixed_windows


def chunk_stream(spark: SparkSession, landing: str, schema: str, size: int = 350, overlap: int = 50) -> DataFrame:
    """Parquet files of ``doc_id, text`` that land in a folder, as a stream of chunks."""
    return fixed_windows(spark.readStream.schema(schema).parquet(landing), size, overlap)


def write_chunks(chunks: DataFrame, path: str, checkpoint: str):
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events a type and window: count and mean value; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
