"""Chunk, registry and audit tables on Parquet.

A ``BucketTable`` holds rows in buckets by a hash of their key. A change writes the buckets that it touches into a folder of its own and then commits a small list of
which folder holds which bucket; readers take the newest list. A change that fails before its commit leaves nothing behind but its folder, which is removed.
A table has one writer at a time; a second one finds its list's number taken and fails, unless both commit within the same moment.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

REGISTRY = "doc_id string, title string, protocol string, version string, file_path string, uploaded_at timestamp, total_pages long, total_chunks long, is_active boolean"


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of ``new`` (its last of a key by ``seq``, if it has that column; of equal ones the one whose other columns sort last) and those of ``old`` of other
    keys. A null key is a key like others."""
    if "seq" in new.columns:
        rest = [F.desc_nulls_last(c) for c in new.columns if c not in (key, "seq")]
        w = Window.partitionBy(key).orderBy(F.desc_nulls_last("seq"), *rest)
        new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "seq")
    keys = new.select(F.col(key).alias("_key")).distinct()
    return old.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti").unionByName(new)


def soft_delete(registry: DataFrame, doc_ids: DataFrame) -> DataFrame:
    gone = doc_ids.select("doc_id").distinct().withColumn("_gone", F.lit(True))
    return registry.join(gone, "doc_id", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone")


def update_payload(chunks: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """``changes(chunk_id, <column>, correction_confidence)``: rows without a confidence change nothing."""
    new = changes.where("correction_confidence is not null").select("chunk_id", F.col(column).alias("_new"))
    return chunks.join(new, "chunk_id", "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of ``ids(chunk_id, ...)`` in the order of their column ``ord``, with its other columns; ids that are not there drop out."""
    return ids.join(chunks, "chunk_id")


def first_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first rows in a stated order."""
    return rows.orderBy(*order).limit(n)


def filtered(chunks: DataFrame, registry: DataFrame | None = None, doc_id=None, protocol: str | None = None, active_only: bool = False) -> DataFrame:
    """Chunks of a document, of a protocol or of active documents; the last two by the registry."""
    out = chunks if doc_id is None else chunks.where(F.col("doc_id") == doc_id)
    if protocol is None and not active_only:
        return out
    docs = registry if protocol is None else registry.where(F.col("protocol") == protocol)
    return out.join(active(docs) if active_only else docs, "doc_id", "left_semi")


def active(registry: DataFrame) -> DataFrame:
    return registry.where("is_active")


def with_vectors(chunks: DataFrame, embed) -> DataFrame:
    """Chunks with ``embed(text column)`` where ``embedding`` is missing or null."""
    if "embedding" not in chunks.columns:
        return chunks.withColumn("embedding", embed("text"))
    return chunks.withColumn("embedding", F.coalesce("embedding", embed("text")))


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | None = None, key: str = "doc_id", buckets: int = 64):
        """``schema``: with it the table is there, and empty, if nothing was written yet."""
        self._spark, self._path, self._schema, self._key, self._buckets = spark, path.rstrip("/"), schema, key, buckets

    def _fs(self, path: str):
        at = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._spark._jsc.hadoopConfiguration()), at

    def _committed(self) -> tuple[int, dict[int, str], str | None]:
        """The newest list: its number, the folder of each bucket, and the rows' schema."""
        store, at = self._fs(f"{self._path}/log")
        found = [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []
        done = [int(n) for n in found if store.exists(self._fs(f"{self._path}/log/{n}/_SUCCESS")[1])]
        if not done:
            return -1, {}, self._schema
        said = json.loads(self._spark.read.text(f"{self._path}/log/{max(done):09d}").first()[0])
        return max(done), {int(k): v for k, v in said["folders"].items()}, said["schema"]

    def _commit(self, number: int, folders: dict[int, str], schema: str) -> None:
        line = json.dumps({"folders": folders, "schema": schema})
        self._spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("error").text(f"{self._path}/log/{number:09d}")

    def _of(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(self._buckets)).cast("int")

    def _rows(self, folders: dict[int, str], schema: str | None) -> DataFrame:
        if not folders:
            if schema is None:
                raise FileNotFoundError(self._path)
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(*[f"{self._path}/data/{f}/bucket={b}" for b, f in sorted(folders.items())])

    def read(self, key=None) -> DataFrame:
        """All rows, or those of a key: of its bucket alone."""
        _, folders, schema = self._committed()
        if key is None:
            return self._rows(folders, schema)
        b = self._spark.range(1).select(F.pmod(F.xxhash64(F.lit(str(key))), F.lit(self._buckets))).first()[0]
        return self._rows({k: f for k, f in folders.items() if k == b}, schema).where(F.col(self._key) == key)

    def _change(self, new: DataFrame | None, keys: DataFrame) -> None:
        """Rows of ``keys`` go, ``new`` ones come; only their buckets are written."""
        number, folders, schema = self._committed()
        keys = keys.select(F.col(self._key).alias("_key")).distinct()
        touched = {r[0] for r in keys.select(self._of("_key")).distinct().collect()}
        schema = new._jdf.schema().toDDL() if new is not None else schema
        held = {b: f for b, f in folders.items() if b in touched}
        rows = new
        if held:
            old = self._rows(held, schema).join(keys, F.col(self._key) == F.col("_key"), "left_anti")
            rows = old if new is None else old.unionByName(new)
        if rows is None:
            return
        folder = uuid.uuid4().hex
        try:
            rows.withColumn("bucket", self._of(self._key)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self._path}/data/{folder}")
            written, at = self._fs(f"{self._path}/data/{folder}")
            there = {int(s.getPath().getName().split("=")[1]) for s in written.listStatus(at) if "=" in s.getPath().getName()}
            kept = {b: f for b, f in folders.items() if b not in touched} | {b: folder for b in there}
            self._commit(number + 1, kept, schema)
        except Exception:
            store, at = self._fs(f"{self._path}/data/{folder}")
            store.delete(at, True)
            raise

    def replace(self, rows: DataFrame) -> None:
        """The rows' keys are replaced as wholes."""
        self._change(rows, rows)

    def delete(self, key) -> None:
        self._change(None, self._spark.createDataFrame([(key,)], f"{self._key} {'long' if isinstance(key, int) else 'string'}"))

    def state(self) -> tuple[dict[int, str], str | None]:
        """What ``restore`` goes back to."""
        return self._committed()[1:]

    def restore(self, folders: dict[int, str], schema: str | None) -> None:
        """Commit an earlier state again; its folders must not have been vacuumed."""
        number, _, now = self._committed()
        self._commit(number + 1, folders, schema or now)

    def vacuum(self) -> None:
        """Remove folders that the newest list does not name. Not while others read or write."""
        _, folders, _ = self._committed()
        store, at = self._fs(f"{self._path}/data")
        for s in store.listStatus(at) if store.exists(at) else []:
            if s.getPath().getName() not in folders.values():
                store.delete(s.getPath(), True)


class ChunkStore(BucketTable):
    """Chunks by document; a document is replaced as a whole."""

    def replace_documents(self, chunks: DataFrame) -> None:
        self.replace(chunks)

    def info(self) -> DataFrame:
        rows = self.read()
        dim = F.max(F.size("embedding")).cast("long") if "embedding" in rows.columns else F.lit(None).cast("long")
        return rows.agg(F.count("*").alias("n"), dim.alias("dim"))


class Registry(BucketTable):
    """The documents that were ingested; there from the start, empty."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, REGISTRY, buckets=8)

    def add(self, rows: DataFrame) -> None:
        self.replace(rows.select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in REGISTRY.split(", ")]))

    def get(self, doc_id: str) -> DataFrame:
        return self.read(doc_id)

    def documents(self, active_only: bool = True) -> DataFrame:
        return active(self.read()) if active_only else self.read()

    def soft_delete(self, doc_id: str, chunks: ChunkStore | None = None) -> None:
        """The document's chunks go, its row stays and is no longer active. A document that is not there is an error."""
        row = self.get(doc_id).withColumn("is_active", F.lit(False))
        found = row.collect()  # one row
        if not found:
            raise KeyError(f"no document {doc_id!r}")
        if chunks is not None:
            chunks.delete(doc_id)
        self.replace(self._spark.createDataFrame(found, row.schema))


def ingest(registry: Registry, chunks: ChunkStore, doc: dict, rows: DataFrame) -> None:
    """Replace a document's chunks and registry row; if the second fails, the chunks are again what they were."""
    spark = rows.sparkSession
    n = rows.count()
    if not n:
        raise ValueError(f"no chunks for {doc['doc_id']}")
    before = chunks.state()
    chunks.replace_documents(rows)
    try:
        names = [c.split(" ")[0] for c in REGISTRY.split(", ")]
        row = {**dict.fromkeys(names), **doc, "total_chunks": n, "is_active": True}
        registry.add(spark.createDataFrame([tuple(row[c] for c in names)], REGISTRY))
    except Exception:
        chunks.restore(*before)
        raise


def chunk_stats(chunks: DataFrame, *by: str) -> DataFrame:
    """``(chunks, chars, tokens, mean_tokens, with_subtitle)`` of the texts of 50 characters or more; the last is the percentage of paths with a subtitle."""
    n = T.token_estimate("text")
    real = chunks.where(F.length("text") >= 50)
    share = F.try_divide(100.0 * F.count_if(F.contains("section_path", F.lit(" - "))), F.count("*"))
    return real.groupBy(*by).agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.sum(n).alias("tokens"), F.round(F.avg(n), 6).alias("mean_tokens"), F.round(share, 6).alias("with_subtitle"))


def document_table(registry: DataFrame) -> DataFrame:
    """``(line)``: a document each, in columns of fixed width."""
    cell = lambda c, n: F.rpad(F.coalesce(c.cast("string"), F.lit("")), n, " ")
    shown = F.concat(
        cell(F.col("protocol"), 15), F.lit(" "), cell(F.col("version"), 10), F.lit(" "), cell(F.substring("title", 1, 28), 30), F.lit(" "), cell(F.col("total_pages"), 8),
        F.lit(" "), cell(F.col("total_chunks"), 8), F.lit(" "), cell(F.date_format("uploaded_at", "yyyy-MM-dd HH:mm:ss"), 20),
    )
    return registry.select("doc_id", shown.alias("line"))


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A report as JSON lines, or as text of a one-column table, in one file."""
    out = rows.coalesce(1).write.mode("overwrite")
    out.json(path) if kind == "json" else out.text(path)


AUDIT = "query_id string, query string, answer string, confidence double, latency_ms double, model string, citations string, ts timestamp"


def audit_rows(answers: DataFrame, model: str, latency_ms: float | None = None) -> DataFrame:
    """Audit rows of answers: citations as JSON, the model and the time that each answer's call tells of. Where it tells none, ``model`` and an even share of ``latency_ms``."""
    n = answers.agg(F.greatest(F.count("*"), F.lit(1)).alias("_n"))  # one row
    share = F.lit(latency_ms).cast("double") / F.col("_n")
    return answers.join(F.broadcast(n)).select(
        F.col("query_id").cast("string").alias("query_id"), "query", "answer", "confidence", F.coalesce("latency_ms", share).alias("latency_ms"), F.coalesce("model", F.lit(model)).alias("model"),
        F.to_json("citations").alias("citations"), F.current_timestamp().alias("ts"),
    )


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def history(audit: DataFrame, limit: int = 100) -> DataFrame:
    return audit.orderBy(F.desc("ts"), "query_id").limit(limit)


def pipeline_stats(audit: DataFrame) -> DataFrame:
    """One row: ``(total_queries, avg_latency_ms, avg_confidence, by_model)``, zeros and an empty map if nothing was asked."""
    models = audit.groupBy("model").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "n")))).alias("by_model"))
    one = audit.agg(F.count("*").alias("total_queries"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))
    return one.join(F.broadcast(models))  # one row each


def latency_sketches(audit: DataFrame, lg: int = 8) -> DataFrame:
    """``(model, day, sketch)``: a KLL sketch of each model's latencies of a day, to be stored and merged. Rows without a latency are left out.

    With ``2^lg`` = 256 items a level a quantile's rank is off by 1.7 % at most, with 99 % confidence; merging keeps that bound.
    """
    return audit.where("latency_ms is not null and ts is not null").groupBy("model", F.to_date("ts").alias("day")).agg(F.kll_sketch_agg_double("latency_ms", F.lit(1 << lg)).alias("sketch"))


def latency_quantiles(sketches: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99), days: int = 7, *by: str) -> DataFrame:
    """``(<by>, since, n, quantiles)`` of windows of ``days`` days (from 1970-01-01 on), merged from stored sketches alone."""
    since = F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(F.unix_date("day") / days) * days).cast("int"))
    held = sketches.groupBy(*by, since.alias("since")).agg(F.kll_merge_agg_double("sketch").alias("s"))
    return held.select(*by, "since", F.kll_sketch_get_n_double("s").alias("n"), F.array(*[F.kll_sketch_get_quantile_double("s", F.lit(q)) for q in quantiles]).alias("quantiles"))


def citations_of(audit: DataFrame) -> DataFrame:
    """The citations of audit rows, read back from their JSON; none where it is null or malformed."""
    kind = "array<struct<number:long,doc_id:string,section_path:string,score:double>>"
    return audit.select("query_id", F.coalesce(F.from_json("citations", kind), F.array().cast(kind)).alias("citations"))


def new_ids(rows: DataFrame, *parts: str) -> DataFrame:
    """Rows with ``chunk_id``, a hash of their parts: the same again on another run."""
    return rows.withColumn("chunk_id", T.stable_id(*parts))
