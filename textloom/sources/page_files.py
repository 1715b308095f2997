"""Files of pages as a data source: one task for each part of a file, and only the pages that are asked for are parsed.

``read(spark, folder, open_pages)`` gives ``(doc_id, page_no, text, error)``. Filters on ``page_no`` (=, <, <=, >, >=, IN) and ``doc_id`` (=, IN) are pushed into the scan: files of
other documents are not opened, pages out of the range not parsed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "doc_id string, page_no int, text string, error string"
#: Bytes of a file for each task; a larger file goes to several, by pages.
SPLIT_BYTES = 64_000_000


class FormFeeds(Sequence):
    """Pages of a text file, apart by form feeds; a page is decoded when it is asked for."""

    def __init__(self, raw: bytes):
        self._parts = raw.removesuffix(b"\n").split(b"\f")

    def __len__(self) -> int:
        return len(self._parts)

    def __getitem__(self, k: int) -> str:
        return self._parts[k].decode(errors="replace")


def document_of(path: str) -> str:
    """A file's document: the value of the last ``name=value`` folder above it, else its name without the ending."""
    *above, name = path.split("/")
    named = [x.split("=", 1)[1] for x in above if "=" in x]
    return named[-1] if named else name.rsplit(".", 1)[0]


@dataclass
class Part(InputPartition):
    """The k-th of n equal shares of a file's wanted pages."""

    path: str
    doc_id: str
    k: int
    n: int


class Reader(DataSourceReader):
    def __init__(self, folder: str, open_pages: Callable[[bytes], Sequence[str]], split_bytes: int):
        self.folder, self.open_pages, self.split_bytes = folder, open_pages, split_bytes
        self.first, self.last, self.pages, self.docs = 1, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrow what is read; a filter that is handed back is Spark's to apply."""
        for f in filters:
            if not self._narrowed(f):
                yield f

    def _narrowed(self, f: Filter) -> bool:
        column = getattr(f, "attribute", None)
        value = getattr(f, "value", None)
        if column == ("doc_id",) and isinstance(f, EqualTo | In):
            own = set(value if isinstance(f, In) else [value])
            self.docs = own if self.docs is None else self.docs & own
            return True
        if column != ("page_no",) or value is None:
            return False
        if isinstance(f, EqualTo | In):
            own = set(value if isinstance(f, In) else [value])
            self.pages = own if self.pages is None else self.pages & own
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.first = max(self.first, value + isinstance(f, GreaterThan))
        elif isinstance(f, LessThan | LessThanOrEqual):
            last = value - isinstance(f, LessThan)
            self.last = last if self.last is None else min(self.last, last)
        else:
            return False
        return True

    def partitions(self) -> list[InputPartition]:
        store, path = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        parts = []
        for f in sorted(found, key=lambda f: f.path):
            if f.type != fs.FileType.File or f.base_name.startswith(("_", ".")):
                continue
            doc_id = document_of(f.path.removeprefix(path))
            if self.docs is None or doc_id in self.docs:
                n = max(1, -(-f.size // self.split_bytes))
                parts += [Part(f.path, doc_id, k, n) for k in range(n)]
        return parts or [Part("", "", 0, 0)]

    def wanted(self, n: int) -> list[int]:
        """Page numbers of a file of n pages."""
        span = range(self.first, min(n, self.last if self.last is not None else n) + 1)
        return [p for p in span if self.pages is None or p in self.pages]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.n:
            return
        rows: list[tuple] = []
        try:
            store, _ = fs.FileSystem.from_uri(self.folder)
            with store.open_input_file(part.path) as f:
                pages = self.open_pages(f.read())
            own = self.wanted(len(pages))
        except Exception as e:  # whatever a parser raises on a broken file is told in the file's row
            rows, own = [(part.doc_id, None, None, f"{type(e).__name__}: {e}")] * (part.k == 0), []
        for page in own[part.k * len(own) // part.n : (part.k + 1) * len(own) // part.n]:
            try:
                rows.append((part.doc_id, page, pages[page - 1], None))
            except Exception as e:
                rows.append((part.doc_id, page, None, f"{type(e).__name__}: {e}"))
            if len(rows) >= 1000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "page_no", "text", "error"])


def read(spark: SparkSession, folder: str, open_pages: Callable[[bytes], Sequence[str]] = FormFeeds, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(doc_id, page_no, text, error)`` of all files below a folder (a URI), hidden ones apart.

    ``open_pages`` turns a file's bytes into a sequence whose items are its pages' texts, worked out when they are asked for (a PDF library goes here).
    A page that fails has its error and a null text; a file that fails has one row with no page number. Empty folders give no rows.
    """

    class PageFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return "textloom_pages"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}", open_pages, split_bytes)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageFiles)
    return spark.read.format("textloom_pages").load()


def write(pages: DataFrame, folder: str) -> None:
    """``pages(doc_id, page_no, text)`` to a file for each document, pages apart by form feeds; a page's own form feeds and line ends of other kinds become spaces and \\\\n."""
    text = F.translate(F.coalesce("text", F.lit("")), "\f\r", " \n")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", text.alias("t")))), lambda p: p["t"]), "\f")
    pages.groupBy("doc_id").agg(whole.alias("value")).write.mode("error").partitionBy("doc_id").text(folder)
