"""Cross-site boilerplate lines by distinct-site spread.

Every line's hash gets a HyperLogLog sketch of the sites (sources) it is on; sketches merge by aggregation, map side
first. Lines whose estimate is clearly below or above the threshold are decided by it; those within the sketch's error get an
exact distinct count. Lines on ``min_sites`` sites or more are then cut from every text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import apply_in_passes, look_up, materialize, releasing, set_slices, sorted_lookup

MIN_SITES = 5
LG_K = 10
BLANK = " \t\n\x0b\f\r"


def _lines(docs: DataFrame) -> DataFrame:
    line = F.explode(F.split(F.coalesce("text", F.lit("")), "\n"))
    rows = docs.select(F.struct("source").alias("site"), line.alias("line")).where(F.trim("line", F.lit(BLANK)) != "")
    return rows.select(F.xxhash64("line").alias("line"), F.xxhash64("site").alias("site"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``(line)``: the xxhash64 of each line that is on ``min_sites`` sites or more (a null source is a site of its own)."""
    lines = _lines(docs)
    spread = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("est"))
    error = 5 * 1.04 / math.sqrt(2**lg_k)
    low, high = math.floor(min_sites * (1 - error)), math.ceil(min_sites * (1 + error))
    spread = materialize(spread.where(F.col("est") >= low), "spread")
    near = spread.where(F.col("est") <= high).select(F.col("line").alias("doc_id"), F.lit(True).alias("near"))
    counted = look_up(lines.withColumnRenamed("line", "doc_id"), near).where("near")
    exact = counted.groupBy("doc_id").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= min_sites)
    return materialize(spread.where(F.col("est") > high).select("line").union(exact.select("doc_id")), "boilerplate")


def cut_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``docs(text, source, ...)`` with boilerplate lines cut from the text, and ``_lines`` and ``_removed`` added.

    Lines are split at \\n and compared whole, byte by byte of their hash; blank lines are neither counted nor cut.
    Null and empty texts stay as they are. Other columns pass through; a row per input row, repeated rows too. Empty tables give no rows.
    """
    n, read = set_slices(boilerplate(docs, min_sites, lg_k))
    docs = docs.select(*docs.columns, F.lit(None).cast("long").alias("_lines"), F.lit(0).cast("long").alias("_removed"))
    schema = docs.schema

    def one_pass(d: DataFrame, hashes: np.ndarray) -> DataFrame:
        sent = d.sparkSession.sparkContext.broadcast(hashes)

        def run(batches):
            inside, some = sorted_lookup(sent.value), len(sent.value) > 0
            for batch in batches:
                texts, lines, removed = (batch.column(c).to_pylist() for c in ("text", "_lines", "_removed"))
                for k, t in enumerate(texts):
                    own = (t or "").split("\n")
                    real = [j for j, x in enumerate(own) if x.strip(BLANK)]
                    if lines[k] is None:
                        lines[k] = len(real)
                    if some and real:
                        cut = inside(np.fromiter((xxhash.xxh64_intdigest(own[j].encode(), 42) for j in real), np.uint64, len(real))).tolist()
                        if cut:
                            gone = {real[c] for c in cut}
                            texts[k] = "\n".join(x for j, x in enumerate(own) if j not in gone)
                            removed[k] += len(gone)
                new = {"text": pa.array(texts, pa.string()), "_lines": pa.array(lines, pa.int64()), "_removed": pa.array(removed, pa.int64())}
                names = batch.schema.names
                yield pa.record_batch([new.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)

        return d.mapInArrow(releasing(run), schema)

    return apply_in_passes(docs, n, read, one_pass, "cut")


def report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``(doc_id, n_lines, n_removed, text_sha256)``: lines with a word, lines cut, and the hash of what stays (null: empty)."""
    out = cut_boilerplate(docs.select("doc_id", "text", "source"), min_sites)
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE_SQL = r"""
WITH lines AS (SELECT doc_id, source AS site, n, l
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)),
marked AS (SELECT *, regexp_matches(l, '[^\x20\x09-\x0D]') AS real FROM lines),
spread AS (SELECT l FROM marked WHERE real GROUP BY l HAVING count(DISTINCT site) + max(CASE WHEN site IS NULL THEN 1 ELSE 0 END) >= 5)
SELECT m.doc_id, CAST(count(*) FILTER (WHERE real) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE s.l IS NOT NULL) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(m.l, chr(10) ORDER BY n) FILTER (WHERE s.l IS NULL), '')) AS text_sha256
FROM marked m LEFT JOIN spread s ON m.l = s.l AND m.real GROUP BY m.doc_id
"""
