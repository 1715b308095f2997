"""WARC archives and their capture index.

Pages are written as gzip members to archive files on shared storage. Of equal payloads of ``MIN_REVISIT`` bytes or more the
one of the smallest page_id is stored, the others become revisit records that refer to it. Each file's captures form a run, sorted where it is
written by URL key and time and stored beside the file in blocks. The merge is external: runs beyond ``FAN_IN`` are first merged in groups
into longer ones; then each task takes a range of (key, time, page), finds its place in every run by bisection and merges them with a loser tree, a block of
each in memory. That gives every URL its captures in order, over all files, however many one URL has.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import files
from .runtime import BROADCAST_ENTRIES, fresh_path, materialize, releasing

MIN_REVISIT = 100
#: Compressed bytes of an archive file, about.
FILE_BYTES = 32_000_000
#: Captures of a block of a run; runs that one task merges; captures of a range of the final merge, and heads of blocks that its cuts are taken from, about.
BLOCK_ROWS = 1024
FAN_IN = 256
RANGE_ROWS = 100_000
MOST_HEADS = 100_000
_CAPTURE = pa.schema([("url_key", pa.string()), ("time", pa.int64()), ("page_id", pa.int64()), ("run", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_RUN = "run string, index string, block long, n long, url_key string, time long, page_id long, offset long"
_BACK = "path string, offset long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class LoserTree:
    """Merge of k sorted iterators: an inner node keeps the loser of the match below it, so an item costs log2 k comparisons."""

    def __init__(self, runs: list[Iterator]):
        self._runs = runs
        self._k = len(runs)
        self._head = [next(r, None) for r in runs]
        self._tree = [-1] * max(1, self._k)
        for i in range(self._k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head[a], self._head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, i: int) -> None:
        node = (i + self._k) // 2
        while node > 0:
            other = self._tree[node]
            if other < 0:  # the first to come waits for its rival
                self._tree[node] = i
                return
            if self._beats(other, i):
                self._tree[node], i = i, other
            node //= 2
        self._tree[0] = i

    def __iter__(self):
        if not self._k:
            return
        while (item := self._head[w := self._tree[0]]) is not None:
            yield item
            self._head[w] = next(self._runs[w], None)
            self._play(w)


def url_key(url: str) -> str:
    """Host labels from the right, then the rest: pages of a site and its subdomains sort together."""
    m = re.match(r"[^:/?#]*://([^/?#]*)(.*)", url, re.DOTALL)
    return f"{','.join(reversed(m[1].lower().split('.')))}){m[2].lower()}" if m else url.lower()


def _header(value: str) -> str:
    return re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _unheader(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def encode_record(page_id: int | None, url: str, when: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit keeps the response's HTTP head, whose Content-Length is the full payload's, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {_header(url)}", f"WARC-Date: {when}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def decode_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive file."""
    at, view = 0, memoryview(data)
    while at < len(data):
        z = zlib.decompressobj(31)
        parts = [z.decompress(view[at : at + (1 << 16)])]
        end = at + (1 << 16)
        while not z.eof:
            if end >= len(data):
                raise ValueError(f"the record at {at} is cut off")
            parts.append(z.decompress(view[end : end + (1 << 20)]))
            end += 1 << 20
        raw = b"".join(parts)
        length = min(end, len(data)) - at - len(z.unused_data)
        head, _, body = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield at, length, fields, body[: int(fields["Content-Length"])]
        at += length


def _rank(capture: tuple) -> tuple:
    """(url_key, time, page_id, run, offset, length) -> what captures are ordered by; null ids last."""
    key, time, page, run, offset, _ = capture
    return key, time, page is None, page or 0, run, offset


def _write_run(uri: str, captures: Iterator[tuple]) -> list[tuple]:
    """Store captures, in order, in blocks; the first capture of each block and its rows."""
    sink, heads, held = io.BytesIO(), [], []
    with pa.ipc.new_file(sink, _CAPTURE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:

        def flush():
            heads.append((held[0], len(held)))
            out.write_batch(pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), _CAPTURE.types)], schema=_CAPTURE))
            held.clear()

        for capture in captures:
            held.append(capture)
            if len(held) == BLOCK_ROWS:
                flush()
        if held:
            flush()
    files.write_file(uri, sink.getbuffer())
    return heads


def _heads(run: str, index: str, heads: list[tuple]) -> pa.RecordBatch:
    rows = [(run, index, k, n, h[0], h[1], h[2], h[4]) for k, (h, n) in enumerate(heads)]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split(" ")[0] for c in _RUN.split(", ")])


class Run:
    """A stored run: blocks are read when they are needed, one at a time."""

    def __init__(self, uri: str):
        self._file = pa.ipc.open_file(files.open_file(uri))
        self._blocks, self._at, self._rows = self._file.num_record_batches, -1, []

    def _block(self, k: int) -> list[tuple]:
        if k != self._at:
            self._at, self._rows = k, list(zip(*(c.to_pylist() for c in self._file.get_batch(k).columns)))
        return self._rows

    def find(self, rank: tuple) -> int:
        """How many captures come before a rank, or before any that starts like it."""
        a, b = 0, self._blocks  # the last block whose first capture comes before
        while a < b:
            m = (a + b) // 2
            a, b = (m + 1, b) if _rank(self._block(m)[0]) < rank else (a, m)
        if not a:
            return 0
        rows = self._block(a - 1)
        low, high = 0, len(rows)
        while low < high:
            m = (low + high) // 2
            low, high = (m + 1, high) if _rank(rows[m]) < rank else (low, m)
        return (a - 1) * BLOCK_ROWS + low

    def rows(self, start: int, end: tuple | None) -> Iterator[tuple]:
        for k in range(start // BLOCK_ROWS, self._blocks):
            for capture in self._block(k)[start % BLOCK_ROWS if k == start // BLOCK_ROWS else 0 :]:
                rank = _rank(capture)
                if end is not None and rank >= end:
                    return
                yield rank, capture


def _write_pass(folder: str, file_bytes: int):
    def run(batches):
        task, n, out, at, rows, attempt = TaskContext.get().partitionId(), 0, io.BytesIO(), 0, [], files.attempt()

        def flush():
            path = f"{folder}/part-{task:06d}-{n:06d}-{attempt}.warc.gz"
            files.write_file(path, out.getbuffer())
            captures = sorted(((key, time, page, path, offset, length) for key, time, page, offset, length in rows), key=_rank)
            return _heads(path, f"{path}.run", _write_run(f"{path}.run", captures))

        for batch in batches:
            for a in range(0, len(batch), 256):
                for r in batch.slice(a, 256).to_pylist():
                    url, html = r["url"] or "", (r["html"] or "").encode()
                    data = encode_record(r["page_id"], url, r["when"], html, r["digest"], r["refers_to"])
                    out.write(data)
                    rows.append((url_key(url), r["time"], r["page_id"], at, len(data)))
                    at += len(data)
                    if at >= file_bytes:
                        yield flush()
                        n, out, at, rows = n + 1, io.BytesIO(), 0, []
        if rows:
            yield flush()

    return run


def revisits(pages: DataFrame) -> DataFrame:
    """``(digest, first)``: payloads of ``MIN_REVISIT`` bytes or more that occur twice or more, and the smallest page_id of each."""
    long = pages.where(F.col("bytes") >= MIN_REVISIT)
    return long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")


def write(pages: DataFrame, folder: str, time: Column | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``pages(page_id integer, url, html)`` -> archive files under ``folder``, each with its run of captures, and the blocks' heads ``(run, index, block, n, url_key, time, page_id, offset)``:
    archive, stored run, number and size of the block, and its first capture.

    ``time``: seconds of a capture (default: page_id after 2024-01-01). Null html is an empty payload, a null url empty. Rows that
    repeat the smallest page_id of a payload are responses each; a null page_id is never referred to. Extra columns are not read. An empty table writes nothing.
    """
    files.make_folder(folder)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("bytes"), (F.lit(1704067200) + F.coalesce("page_id", F.lit(0)) if time is None else time).cast("long").alias("time"))
    firsts = materialize(revisits(rows), "firsts")
    side = F.broadcast(firsts) if firsts.count() <= BROADCAST_ENTRIES // 40 else firsts
    rows = rows.join(side, "digest", "left")
    refers = F.when((F.col("bytes") >= MIN_REVISIT) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    when = F.date_format(F.timestamp_seconds("time"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = rows.select("page_id", F.coalesce("url", F.lit("")).alias("url"), "html", "digest", "time", when.alias("when"), refers.alias("refers_to"))
    return materialize(rows.mapInArrow(releasing(_write_pass(folder, file_bytes)), _RUN), "runs")


def _longer_runs(runs: DataFrame, groups: int) -> DataFrame:
    """Merge the stored runs in groups into one run each."""
    folder = fresh_path(runs.sparkSession, "runs")
    files.make_folder(folder)

    def run(batches):
        attempt, of = files.attempt(), {}
        for batch in batches:
            for g, index in zip(batch.column("g").to_pylist(), batch.column("index").to_pylist()):
                of.setdefault(g, []).append(index)
        for g, own in sorted(of.items()):
            uri = f"{folder}/merged-{g:06d}-{attempt}.run"
            tree = LoserTree([Run(x).rows(0, None) for x in sorted(own)])
            yield _heads(uri, uri, _write_run(uri, (capture for _, capture in tree)))

    named = runs.select("index").distinct().select("index", F.pmod(F.xxhash64("index"), F.lit(groups)).cast("int").alias("g"))
    return materialize(named.repartitionById(groups, "g").mapInArrow(releasing(run), _RUN), "runs")


def merge_runs(runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The capture index from the heads that ``write`` gives: ``(part, nth, url_key, capture_nth, time, page_id, run, offset, length)``, in order over all files by (part, nth);
    ``capture_nth`` counts a URL's captures from 1. Nothing from an empty manifest."""
    spark = runs.sparkSession
    while (n := runs.select("index").distinct().count()) > FAN_IN:
        runs = _longer_runs(runs, -(-2 * n // FAN_IN))
    index = sorted(r[0] for r in runs.select("index").distinct().collect())  # FAN_IN at most
    blocks, total = runs.agg(F.count("*"), F.sum("n")).first()
    parts = partitions or max(1, -(-(total or 0) // RANGE_ROWS))
    some = runs if blocks <= MOST_HEADS else runs.where(F.pmod(F.xxhash64("index", "block"), F.lit(-(-blocks // MOST_HEADS))) == 0)
    heads = sorted(_rank((*r, 0)) for r in some.select("url_key", "time", "page_id", "run", "offset").collect())
    cuts = [heads[len(heads) * k // parts] for k in range(1, parts)] if heads else []
    sent = spark.sparkContext.broadcast((index, cuts))

    def run(batches):
        index, cuts = sent.value
        names = ["part", "nth", "url_key", "capture_nth", "time", "page_id", "run", "offset", "length"]
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for part in (p for b in batches for p in b.column("id").to_pylist()):
            low, high = cuts[part - 1] if part else None, cuts[part] if part < len(cuts) else None
            opened = [Run(x) for x in index]
            starts = [r.find(low) if low else 0 for r in opened]
            tree = LoserTree([r.rows(a, high) for r, a in zip(opened, starts)])
            rows, nth, seen, key = [], 0, 0, None
            for _, (url, time, page, path, offset, length) in tree:
                if url != key:
                    # captures of the range's first URL may lie before it; the runs that are being read keep their blocks
                    seen = sum(max(0, a - Run(x).find((url,))) for x, a in zip(index, starts)) if key is None and low else 0
                    key = url
                seen += 1
                rows.append((part, nth, url, seen, time, page, path, offset, length))
                nth += 1
                if len(rows) == 10_000:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    ranges = spark.range(0, parts if index else 0).select(F.col("id").cast("int").alias("id")).repartitionById(parts, "id")
    return ranges.mapInArrow(releasing(run), "part int, nth long, url_key string, capture_nth long, time long, page_id long, run string, offset long, length long")


def read(paths: DataFrame) -> DataFrame:
    """``paths(path)`` of archive files -> every record's page, payload size and digest, type and the page it refers to. The digest of a stored payload is taken anew."""

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["path", "offset", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for at, _, f, block in decode_records(files.read_file(path)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stored = f["WARC-Type"] == "response"
                    size = len(payload) if stored else int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = hashlib.sha256(payload).hexdigest() if stored else f["WARC-Payload-Digest"].removeprefix("sha256:")
                    number = lambda k, f=f: int(f[k]) if k in f else None
                    rows.append((path, at, number("X-Page-Id"), _unheader(f["WARC-Target-URI"]), size, digest, f["WARC-Type"], number("X-Refers-To-Page-Id")))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return paths.repartition(max(1, paths.count())).mapInArrow(releasing(run), _BACK)


def archive(pages: DataFrame, time: Column | None = None) -> DataFrame:
    """Write, merge the index, read back what it names: ``(page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, capture_nth, part, nth)``, a row per page."""
    runs = write(pages, fresh_path(pages.sparkSession, "warc"), time)
    index = merge_runs(runs)
    back = read(runs.select(F.col("run").alias("path")).distinct())
    at = index.select(F.col("run").alias("path"), "offset", "url_key", "capture_nth", "part", "nth")
    # both sides grow with the pages, though the planner sees only file names on one
    return back.hint("shuffle_merge").join(at, ["path", "offset"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_nth", "part", "nth")


ORACLE_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
p AS (SELECT *, CASE WHEN regexp_matches(url, '^[^:/?#]*://') THEN array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^[^:/?#]*://([^/?#]*)', 1)), '.')), ',') || ')' || lower(regexp_extract(url, '(?s)^[^:/?#]*://[^/?#]*(.*)', 1)) ELSE lower(url) END AS url_key FROM u),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to, url_key, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS capture_nth
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
