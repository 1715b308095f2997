"""Shared storage, materialised tables, size-checked sets, and what Python workers keep."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes sent to every executor at once; what is larger goes in several passes or by a join.
BROADCAST_BYTES = 32_000_000
#: A row of two or three numbers in a joined side that is sent, with what the hash table adds.
ROW_BYTES = 64
#: Set entries sent at once (8 bytes each).
BROADCAST_ENTRIES = BROADCAST_BYTES // 8
#: Seconds after its last task in which a worker keeps what it may need again.
IDLE_SECONDS = 3.0

_warm: list[dict] = []
_timer: threading.Timer | None = None


def keep_warm(holder: dict) -> None:
    """Things kept from task to task in ``holder`` are let go of when the worker has been idle for ``IDLE_SECONDS``."""
    if not any(h is holder for h in _warm):
        _warm.append(holder)


def _free() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _cool() -> None:
    for holder in _warm:
        holder.clear()
    _free()


def releasing(run):
    """A mapInArrow function that hands its worker's free memory back when a task ends, and soon after what the worker keeps warm: idle
    workers stay, and their heaps would count."""

    def wrapped(batches):
        global _timer
        if _timer is not None:
            _timer.cancel()
        try:
            yield from run(batches)
        finally:
            _free()
            if any(_warm):
                _timer = threading.Timer(IDLE_SECONDS, _cool)
                _timer.daemon = True
                _timer.start()

    return wrapped


def shared_root(spark: SparkSession) -> str:
    """The folder that every executor sees; a private one only in a local session that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        root = f"file://{root}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_written: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clean_up(spark: SparkSession) -> None:
    """Delete all that this process has written to the shared folder. Results that were not written elsewhere can no longer be read."""
    while _written:
        remove(spark, _written.pop())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to shared storage and read from there: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete materialised tables that nothing will read again."""
    for df in tables:
        if (path := getattr(df, "_textloom_path", None)) is not None:
            remove(df.sparkSession, path)
            df._textloom_path = None
            _written.remove(path)


def tidy(spark: SparkSession) -> None:
    """Between the parts of an operator that plans many jobs: let the driver go of finished plans, and so Spark's cleaner of their shuffles and broadcasts."""
    gc.collect()
    spark._jvm.System.gc()


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    store, at = _store(spark, path)
    store.delete(at, True)


def make_path(spark: SparkSession, path: str) -> None:
    store, at = _store(spark, path)
    store.mkdirs(at)


def move(spark: SparkSession, path: str, to: str) -> None:
    store, at = _store(spark, path)
    if not store.rename(at, _store(spark, to)[1]):
        raise OSError(f"{path} could not be moved to {to}")


def set_slices(ids: DataFrame, bound: int = BROADCAST_ENTRIES) -> tuple[int, Callable[[int], np.ndarray]]:
    """The distinct longs of a one-column table, counted first: how many slices of about ``bound`` entries, and a reader of the kth, sorted."""
    name = ids.columns[0]
    ids = ids.where(F.col(name).isNotNull()).distinct()
    n = max(1, -(-ids.count() // bound))

    def read(k: int) -> np.ndarray:
        part = ids if n == 1 else ids.where(F.pmod(F.xxhash64(name, F.lit("slice")), F.lit(n)) == k)
        return np.sort(part.toArrow().column(0).to_numpy().astype(np.int64))

    return n, read


def sorted_lookup(table: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Membership in a sorted array of 64-bit hashes, by a bitmap first: the places of those that are in it."""
    size = max(12, int(np.ceil(np.log2(16 * max(1, len(table))))))
    shift = np.uint64(64 - size)
    seen = np.zeros(1 << size, bool)
    seen[table.view(np.uint64) >> shift] = True

    def at(h: np.ndarray) -> np.ndarray:
        found = np.flatnonzero(seen[h >> shift])
        own = h[found].view(np.int64)
        place = np.searchsorted(table, own)
        place[place == len(table)] = 0
        return found[table[place] == own] if len(table) else found[:0]

    return at


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has, whatever its capitals."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id", bound: int = BROADCAST_BYTES // ROW_BYTES) -> DataFrame:
    """Rows whose id is not in ``ids``: a bounded set is sent to the executors, a larger one is anti-joined."""
    name, own = ids.columns[0], unused(docs, "id")
    ids = materialize(ids.where(F.col(name).isNotNull()).select(F.col(name).cast("long").alias(own)).distinct(), "ids")
    n = ids.count()
    if n == 0:
        return docs
    return docs.join(ids.hint("shuffle_merge") if n > bound else F.broadcast(ids), docs[column] == ids[own], "left_anti")


def look_up(docs: DataFrame, values: DataFrame, bound: int = BROADCAST_BYTES // ROW_BYTES, column: str = "doc_id") -> DataFrame:
    """Left join ``values(<column> unique, numbers ...)`` to ``docs``: sent to the executors if of ``bound`` rows at most, else by a shuffle."""
    own = unused(docs, unused(values, "id"))
    values = values.withColumnRenamed(column, own)
    side = F.broadcast(values) if values.count() <= bound else values.hint("shuffle_merge")
    return docs.join(side, docs[column] == values[own], "left").drop(own)


def apply_in_passes(docs: DataFrame, n: int, chunk: Callable[[int], object], scan: Callable[[DataFrame, object], DataFrame], name: str) -> DataFrame:
    """Apply ``scan`` once for each of ``n`` chunks of a set; between passes the table is written, so that one chunk is held at a time."""
    before = None
    for k in range(n):
        docs = scan(docs, chunk(k))
        if k + 1 < n:
            docs = materialize(docs, name)
            discard(before)
            before = docs
    return docs
