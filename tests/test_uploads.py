"""Uploads that are sent again, batches that run again, and restarts: no second chunks."""

import os

from pyspark.sql import functions as F

from textloom.operators.chunking import fixed_windows
from textloom.streaming import uploads

SCHEMA = "doc_id string, text string, seq long"


def test_versions_replays_and_restarts(spark, tmp_path):
    landing, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def land(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landing)

    def take():
        uploads.start(spark, landing, path, checkpoint, lambda d: fixed_windows(d, 4, 1)).awaitTermination()

    def now():
        return sorted(((r.doc_id, r.version, r.chunk_index, r.text) for r in uploads.current(spark, path).collect()), key=str)

    long = "one two three four five six"
    windows = lambda d, v: [(d, v, 0, "one two three four"), (d, v, 1, "four five six")]
    land(("a", long, 1), ("b", "old b", 1), ("b", "new b", 2), ("b", "no order", None), (None, "nameless", 1), ("e", None, 1))
    take()
    first = sorted([*windows("a", 1), ("b", 1, 0, "new b"), (None, 1, 0, "nameless")], key=str)
    assert now() == first
    # sent again, restarted: nothing new
    land(("a", long, 7), ("b", "new b", 9))
    take()
    assert now() == first
    # the batch was written but not committed: it runs again and writes the same folder once more
    done = sorted(int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())
    land(("a", "only this", 8), ("c", "c c", 1))
    take()
    after = sorted([("a", 2, 0, "only this"), ("b", 1, 0, "new b"), ("c", 1, 0, "c c"), (None, 1, 0, "nameless")], key=str)
    assert now() == after
    last = done[-1] + 1
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    take()
    assert now() == after and spark.read.parquet(f"{path}/chunks").where(F.col("doc_id") == "c").count() == 1
    # back to a former text is a new version, an empty one leaves no chunks
    land(("a", long, 10), ("c", " ", 2))
    take()
    assert now() == sorted([*windows("a", 3), ("b", 1, 0, "new b"), (None, 1, 0, "nameless")], key=str)
