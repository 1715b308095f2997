"""Vector code compression: product codes whose codebooks are fitted by Lloyd rounds that move only what changed.

Vectors become integers once, and lie in buckets by a row key. A round reads them beside their previous codes (of the same buckets, so no shuffle), assigns
every part to its codebook's nearest entry and writes the new codes. Of parts whose assignment changed, and of no others, a task adds up what an entry gains and what
it loses; these plus and minus sums are shuffled and added to the running integer sums, from which the entries follow. All sums are exact integers.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import discard, fresh_path, look_up, materialize, releasing

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: Components from this size on are dropped like those that are not finite: the squares of 64 smaller ones still add up in 64 bits.
LARGEST = 2.0**27 / SCALE
#: Rows of a bucket: what a task holds of previous codes, and reads. Few rows still go to all cores, in buckets of so many at least.
BUCKET_ROWS = 250_000
LEAST_ROWS = 4096
_STEP = "key long, codes binary, error long, part int, entry int, n long, sums array<long>"


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, v array<int>)`` of the rows that are kept: those whose vector is there, not empty, and holds finite components smaller than ``LARGEST``."""
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(LARGEST), F.lit(False)))
    kept = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(fine)
    return kept.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def _nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``parts[row, part, place]``, ``books[part, entry, place]`` -> the nearest entry of each part (ties: the lower) and its squared distance."""
    best, code = np.full(parts.shape[:2], np.iinfo(np.int64).max), np.zeros(parts.shape[:2], np.uint8)
    for e in range(books.shape[1]):
        d = parts - books[:, e]
        d = np.einsum("rpj,rpj->rp", d, d)
        nearer = d < best
        best[nearer], code[nearer] = d[nearer], e
    return code, best


def _round(books: np.ndarray):
    """New codes of each row, then what the parts that changed add to and take from the entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_parts, n_entries, width = books.shape
        sums, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        which = np.arange(n_parts)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, n_parts, width)
            code, error = _nearest(v, books)
            old = batch.column("codes")
            was = np.frombuffer(b"".join(x for x in old.to_pylist() if x is not None), np.uint8).reshape(-1, n_parts)
            had = old.is_valid().to_numpy(zero_copy_only=False)
            moved = np.ones(code.shape, bool)
            moved[had] = code[had] != was
            row, part = np.nonzero(moved)
            np.add.at(sums, (part, code[row, part]), v[row, part])
            np.add.at(count, (part, code[row, part]), 1)
            row, part = np.nonzero(moved[had])
            before = v[had]
            np.subtract.at(sums, (part, was[row, part]), before[row, part])
            np.subtract.at(count, (part, was[row, part]), 1)
            nulls = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column("key"), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(error.sum(1)), *nulls], names=["key", "codes", "error", "part", "entry", "n", "sums"])
        part, entry = np.nonzero((count != 0) | (sums != 0).any(2))
        nulls = [pa.nulls(len(part), t) for t in (pa.int64(), pa.binary(), pa.int64())]
        yield pa.record_batch([*nulls, pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], names=["key", "codes", "error", "part", "entry", "n", "sums"])

    return releasing(run)


class _Buckets:
    """Tables of one row key, bucketed alike in the shared folder, so that they join without a shuffle."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n, self.names = spark, n, {}

    def write(self, df: DataFrame, *by: str) -> DataFrame:
        name, path = f"textloom_{uuid.uuid4().hex}", fresh_path(self.spark, "vectors")
        df.write.format("parquet").option("compression", "zstd").option("path", path).partitionBy(*by).bucketBy(self.n, "key").saveAsTable(name)
        out = self.spark.table(name)
        out._textloom_path, self.names[path] = path, name
        return out

    def drop(self, df: DataFrame | None) -> None:
        if df is not None:
            self.spark.sql(f"DROP TABLE {self.names.pop(df._textloom_path)}")
            discard(df)


def encode(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, np.ndarray]:
    """``rows(vec_id, embedding, label)`` -> ``(vec_id, label, codes binary, error long)`` for each kept row, and the codebooks ``[part, entry, place]``.

    The first ``entries`` rows by vec_id (then by components) give the first codebooks; fewer rows give fewer entries. A null vec_id comes after all others.
    Vectors of another length than the first row's cannot be compared with it and are dropped like broken ones; a length that ``parts`` does not divide is an error.
    Rows that share a vec_id are told apart by a row key and all returned. No kept rows give no rows and empty codebooks. Extra columns are not read.
    """
    spark = rows.sparkSession
    kept = materialize(integer_vectors(rows, scale).withColumn("key", F.monotonically_increasing_id()), "integers")
    in_order = (F.col("vec_id").asc_nulls_last(), "v", "key")
    first = kept.orderBy(*in_order).limit(1).select(F.size("v").alias("n")).first()
    if first is None:
        return kept.select("vec_id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    if first["n"] % parts:
        raise ValueError(f"vectors of {first['n']} components cannot be cut into {parts} equal parts")
    alike = kept.where(F.size("v") == first["n"])
    start = alike.orderBy(*in_order).limit(entries).select("v").collect()
    books = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    # The running sums and counts of all entries: as many numbers as the codebooks have.
    sums, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    n = alike.count()
    buckets = _Buckets(spark, max(math.ceil(n / bucket_rows), min(spark.sparkContext.defaultParallelism, math.ceil(n / LEAST_ROWS))))
    vectors = buckets.write(alike.repartition(buckets.n, "key"))
    discard(kept)
    codes = None
    for k in range(rounds + 1):
        before = vectors.select("key", "v")
        if codes is None:
            before = before.withColumn("codes", F.lit(None).cast("binary"))
        else:
            before = before.join(codes.where("not moved").select("key", "codes").hint("shuffle_hash"), "key")
        was, codes = codes, buckets.write(before.mapInArrow(_round(books), _STEP).withColumn("moved", F.col("key").isNull()), "moved")
        buckets.drop(was)
        if k == rounds:
            break
        places = [F.sum(F.col("sums")[i]) for i in range(books.shape[2])]
        for part, entry, more, *s in codes.where("moved").groupBy("part", "entry").agg(F.sum("n"), *places).collect():
            count[part, entry] += more
            sums[part, entry] += s
        next_books = np.where((count > 0)[:, :, None], sums // np.maximum(count, 1)[:, :, None], books)
        if (next_books == books).all():
            break
        books = next_books
    out = materialize(vectors.select("key", "vec_id", "label").join(codes.where("not moved").select("key", "codes", "error").hint("shuffle_hash"), "key").drop("key"), "codes")
    buckets.drop(codes)
    buckets.drop(vectors)
    return out, books


def report(rows: DataFrame, **settings: int) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of each kept row: two hex digits a part, the squared distances to its entries, and
    those of all rows of its label (null: a label of its own)."""
    coded, books = encode(rows, **settings)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    named = coded.withColumn("label_key", F.coalesce(F.col("label").cast("string"), F.lit("")))
    errors = materialize(named.groupBy("label_key").agg(F.sum("error").alias("label_error")), "label_errors")
    return look_up(named, errors, column="label_key").select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The rounds written out, each from its assignments alone."""
    nearest = """a{k} AS (
    SELECT r, p, v, e, d FROM (
        SELECT x.r, x.p, x.v, b.e, d, row_number() OVER (PARTITION BY x.r, x.p ORDER BY d, b.e) AS o
        FROM parts x JOIN b{k} b USING (p), LATERAL (SELECT list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d))
    WHERE o = 1)"""
    update = """m{k} AS (
    SELECT p, e, list(m ORDER BY j) AS v FROM (
        SELECT p, e, j, floor_div AS m FROM (
            SELECT p, e, j, (sum(v[j]) - ((sum(v[j]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div FROM a{k}, range(1, len(v) + 1) g(j) GROUP BY 1, 2, 3)) GROUP BY 1, 2),
b{n} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (p, e))"""
    steps = [nearest.format(k=0)]
    for k in range(rounds):
        steps += [update.format(k=k, n=k + 1), nearest.format(k=k + 1)]
    return f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v FROM (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), parts AS (
    SELECT r, p::INT AS p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS v FROM kept, range({parts}) g(p)
), b0 AS (SELECT p, r - 1 AS e, v FROM parts WHERE r <= {entries}),
{(','+chr(10)).join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS digest FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256 FROM coded JOIN kept USING (r), book
"""
