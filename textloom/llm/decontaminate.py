"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Training texts are scanned once; a window's hash is looked up in a bitmap, then in the sorted hashes, and a
hit counts only after its words are compared with the test window's. Test sets beyond ``most_bytes`` of text
are taken in slices, one pass over the texts each, so that what is broadcast stays bounded.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .runtime import apply_in_passes, releasing

#: Bytes of test text whose windows are broadcast at once: measured, a window takes about 60 bytes, so a slice about 40 MB.
MOST_BYTES = 4_000_000


class Windows:
    """The windows of some test items, as arrays: by length, sorted hashes with the first word and the item of each; the words are slices of one text."""

    def __init__(self, names: list[str], texts: pa.Array, n: int):
        data, off = kernel.text_bytes(texts)
        h, start, end, w = kernel.words(data, off, kernel.ALNUM)
        self.names = names
        self._text, self._start, self._end = kernel.LOWER[data].tobytes(), start.astype(np.int32), end.astype(np.int32)
        size = np.minimum(np.diff(w), n)
        self.sizes: dict[int, tuple] = {}
        for length in np.unique(size[size > 0]).tolist():
            g, item = kernel.grams(h, length), np.repeat(np.arange(len(names), dtype=np.int32), np.diff(w))
            at = np.arange(len(g), dtype=np.int32)
            real = (size[item[at]] == length) & (at + length <= w[item[at] + 1])
            at = at[real]
            order = np.lexsort((item[at], g[at]))
            at = at[order]
            again = np.zeros(len(at), bool)  # a window that an item repeats
            again[1:] = (g[at][1:] == g[at][:-1]) & (item[at][1:] == item[at][:-1])
            at = at[~again]
            hashes = g[at]
            bits = max(12, int(np.ceil(np.log2(8 * len(hashes)))))
            seen = np.zeros(1 << bits, bool)
            seen[hashes >> np.uint64(64 - bits)] = True
            self.sizes[length] = hashes, at, item[at], bits, seen

    def _words(self, first: int, size: int) -> list[bytes]:
        return [self._text[a:b] for a, b in zip(self._start[first : first + size].tolist(), self._end[first : first + size].tolist())]

    def hits(self, data: np.ndarray, off: np.ndarray):
        """For each document: number of words, mask of hit words, items."""
        h, start, end, w = kernel.words(data, off, kernel.ALNUM)
        low = kernel.LOWER[data]
        mask = np.zeros(len(h), bool)
        items: dict[int, set] = defaultdict(set)
        for size, (hashes, first, item, bits, seen) in self.sizes.items():
            g = kernel.grams(h, size)
            at = np.flatnonzero(seen[g >> np.uint64(64 - bits)])
            place, to = np.searchsorted(hashes, g[at], "left"), np.searchsorted(hashes, g[at], "right")
            doc = np.searchsorted(w, at, "right") - 1
            inside = (to > place) & (at + size <= w[doc + 1])
            for i, a, b, d in zip(at[inside].tolist(), place[inside].tolist(), to[inside].tolist(), doc[inside].tolist()):
                own = [low[start[j] : end[j]].tobytes() for j in range(i, i + size)]
                found = [int(item[p]) for p in range(a, b) if self._words(int(first[p]), size) == own]
                if found:
                    mask[i : i + size] = True
                    items[d].update(self.names[x] for x in found)
        return w, mask, items


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Add ``_words``, ``_hit`` (a bit for each word of the text that lies in a test window; null: none), ``_n_hit`` and ``_items``.

    Words are runs of a-z, 0-9 and characters beyond ASCII, after lower-casing A-Z. An item of fewer than ``n``
    words is one window; one without words has none. Null and empty texts have no words. Test items are known by
    the string of their id (null: empty); repeated items count once. The columns of ``docs`` pass through. Empty
    tables give no rows, an empty benchmark no hits.
    """
    spark = docs.sparkSession
    docs = docs.select(
        *docs.columns, F.lit(0).cast("long").alias("_words"), F.lit(None).cast("binary").alias("_hit"), F.lit(0).cast("long").alias("_n_hit"), F.array().cast("array<string>").alias("_items")
    )
    schema = docs.schema
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")
    slices = max(1, -(-(bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most_bytes))

    def windows(i: int) -> Windows:
        part = bench if slices == 1 else bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == i)
        rows = part.distinct().toArrow()  # bounded by the check above
        return Windows(rows["item"].to_pylist(), rows["text"].combine_chunks(), n)

    def one_pass(d: DataFrame, test: Windows) -> DataFrame:
        sent = spark.sparkContext.broadcast(test)

        def run(batches):
            for batch in batches:
                data, off = kernel.text_bytes(batch.column("text"))
                hit, items, n_hit = batch.column("_hit").to_pylist(), batch.column("_items").to_pylist(), batch.column("_n_hit").to_pylist()
                n_words = []
                for i, j in kernel.pieces(off):
                    w, mask, found = sent.value.hits(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    n_words += np.diff(w).tolist()
                    for k, own in found.items():
                        bits = np.packbits(mask[w[k] : w[k + 1]])
                        if (before := hit[i + k]) is not None:
                            bits |= np.frombuffer(before, np.uint8)
                        hit[i + k], n_hit[i + k] = bits.tobytes(), int(np.unpackbits(bits).sum())
                        items[i + k] = sorted({*items[i + k], *own})
                new = {"_words": pa.array(n_words, pa.int64()), "_hit": pa.array(hit, pa.binary()), "_n_hit": pa.array(n_hit, pa.int64()), "_items": pa.array(items, pa.list_(pa.string()))}
                names = batch.schema.names
                yield pa.record_batch([new.get(c, batch.column(k)) for k, c in enumerate(names)], names=names)

        return d.mapInArrow(releasing(run), schema)

    return apply_in_passes(docs, slices, windows, one_pass, "scanned")


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, a row per document."""
    found = scan(docs.select("doc_id", "text"), benchmark, n, most_bytes)
    ids = F.sha2(F.array_join(F.array_sort("_items"), ","), 256)
    return found.select(
        "doc_id", F.col("_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated")
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The documents without any hit, columns as they come."""
    return scan(docs, benchmark, n, most_bytes).where("_n_hit = 0").select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Every document, its hit words (from the first byte of the first to the last byte of the last of a run) cut out of the text."""
    found = scan(docs, benchmark, n, most_bytes)

    def run(batches):
        for batch in batches:
            texts, hits = batch.column("text").to_pylist(), batch.column("_hit").to_pylist()
            for k, (t, b) in enumerate(zip(texts, hits)):
                if b is None:
                    continue
                raw = t.encode()
                data = np.frombuffer(raw, np.uint8)
                _, start, end, w = kernel.words(data, np.array([0, len(data)]), kernel.ALNUM)
                own = np.unpackbits(np.frombuffer(b, np.uint8))[: len(start)].astype(np.int8)
                edge = np.diff(own, prepend=0, append=0)
                out, at = [], 0
                for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                    out.append(raw[at : start[i]])
                    at = end[j - 1]
                texts[k] = b"".join([*out, raw[at:]]).decode()
            names = batch.schema.names
            yield pa.record_batch([pa.array(texts, pa.string()) if c == "text" else batch.column(k) for k, c in enumerate(names)], names=names)

    return found.mapInArrow(releasing(run), found.schema).select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, t)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
