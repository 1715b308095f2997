"""Chunkers: fixed windows, long-section splitting, and packers of layout elements."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def fixed_windows(docs: DataFrame, size: int = 350, overlap: int = 50) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, chunk_index, total_chunks, n_tokens, text)``: token windows that stop at the end of the text."""
    words = docs.select("doc_id", T.tokens("text").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    # the windows are cut before they are dealt out, so that a row carries its own words alone
    windows = F.transform(starts, lambda s: F.slice("w", s + 1, F.lit(size)))
    rows = words.select("doc_id", F.size(starts).cast("long").alias("total_chunks"), F.posexplode(windows).alias("chunk_index", "own"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "total_chunks", F.size("own").cast("long").alias("n_tokens"), F.array_join("own", " ").alias("text"))


def split_long(sections: DataFrame, max_tokens: int = 800, overlap: int = 50) -> DataFrame:
    """``sections(doc_id, text)`` -> ``(doc_id, chunk_index, total_chunks, text)``; null texts give no rows, an empty one a row.

    Texts over ``max_tokens`` (a quarter of their characters) are cut into paragraphs, those over it into sentences, and packed;
    a chunk opens with the last ``4 * overlap`` characters of the one before. As that tail ends where the chunk's own parts begin, each chunk is
    one stretch of the joined parts: the fold carries sizes alone, and texts are cut at the end.
    """
    size = lambda n: F.floor(n / 4).cast("int")
    parts = F.flatten(F.transform(F.split("text", "\n\n"), lambda p: F.when(size(F.length(p)) > max_tokens, T.sentences(p)).otherwise(F.array(p))))
    long = size(F.length("text")) > max_tokens
    rows = sections.where("text is not null").select("doc_id", F.when(long, parts).otherwise(F.array("text")).alias("parts"))
    rows = rows.select("doc_id", F.array_join("parts", "\n\n").alias("joined"), F.transform("parts", F.length).alias("sizes"))

    def step(a, n):
        tail = F.least(F.lit(4 * overlap), a["end"] - a["begin"])
        state = lambda done, begin, tokens: F.struct(done.alias("done"), begin.alias("begin"), (a["at"] + n).alias("end"), (a["at"] + n + 2).alias("at"), tokens.alias("tokens"), F.lit(True).alias("any"))
        fits = state(a["done"], F.when(a["any"], a["begin"]).otherwise(a["at"]), a["tokens"] + size(n))
        new = state(F.concat(a["done"], F.array(F.struct(a["begin"].alias("b"), a["end"].alias("e")))), F.when(tail > 0, a["at"] - 2 - tail).otherwise(a["at"]), size(tail) + size(n))
        return F.when(a["tokens"] + size(n) <= max_tokens, fits).when(a["any"], new).otherwise(state(a["done"], a["at"], size(n)))

    def finish(a):
        every = F.concat(a["done"], F.array(F.struct(a["begin"].alias("b"), a["end"].alias("e"))))
        return F.transform(F.array(every), lambda x: F.struct(x.alias("cuts"), F.size(x).cast("long").alias("n")))[0]

    none = F.lit(0)
    start = F.struct(F.array().cast("array<struct<b:int,e:int>>").alias("done"), none.alias("begin"), none.alias("end"), none.alias("at"), none.alias("tokens"), F.lit(False).alias("any"))
    rows = rows.select("doc_id", "joined", F.aggregate("sizes", start, step, finish).alias("c"))
    rows = rows.select("doc_id", "joined", F.col("c.n").alias("total_chunks"), F.posexplode("c.cuts").alias("chunk_index", "cut"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "total_chunks", F.col("joined").substr(F.col("cut.b") + 1, F.col("cut.e") - F.col("cut.b")).alias("text"))


_PACKED = "doc_id long, chunk_index long, text string, n_tokens long, page_numbers array<int>, chunk_type string, section_title string, section_path string"
# Fixed value: a numbered heading at the start of a line.
_HEADING = re.compile(r"(?m)^\s*(\d+(?:\.\d+)*)\s+([A-Z][^\n]*)")


def _numbers(title: str | None) -> list[int]:
    t = (title or "").strip()
    m = re.match(r"[\d.]+", t) or re.match(r"(?:Appendix\s+)?[A-Z]\.?([\d.]+)", t)
    return [int(x) for x in m[m.lastindex or 0].split(".") if x] if m else []


def is_major(old: str | None, new: str | None, levels: int = 3) -> bool:
    if not old or not new:
        return False
    a, b = _numbers(old), _numbers(new)
    if not a or not b:
        return old != new
    return len(a) != len(b) or a[:levels] != b[:levels]


def common_front(texts: list[str]) -> str:
    """The section number that all numbered headings in some texts have in front, if there are several headings; else ''."""
    heads = [_numbers(m[1]) for m in _HEADING.finditer(" ".join(texts))]
    front = []
    for level in zip(*[h for h in heads if h]) if len(heads) > 1 else ():
        if len(set(level)) > 1:
            break
        front.append(str(level[0]))
    return ".".join(front)


class _Packer:
    """Greedy packing of one document's elements, as they come: what is open is a list of (text, tokens) and what they are credited with."""

    def __init__(self, size: int, overlap: int, minimum: int, maximum: int, levels: int, by_section: bool, compound: bool, count: Callable[[str], int]):
        self.size, self.overlap, self.minimum, self.maximum, self.levels = size, overlap, minimum, maximum, levels
        self.by_section, self.compound, self.count = by_section, compound, count

    def chunks(self, elements: Iterable[dict]) -> Iterator[dict]:
        self.parts, self.tokens, section = [], 0, None
        self._reset()
        for e in elements:
            n, title, path, pages = self.count(e["text"]), e["section_title"] or None, e["section_path"] or None, e["page_numbers"] or [1]
            if e["type"] == "table" and n > self.size:
                yield from self._close(seed=False)
                yield self._chunk([e["text"]], pages, title, path, "table")
                section = title
                continue
            full = self.tokens + n > self.size
            if self.by_section:
                if section and title and self.parts and self.tokens >= self.minimum and is_major(section, title, self.levels):
                    yield from self._close(seed=False)
                full = self.tokens + n > self.maximum or self.tokens + n > self.size and self.tokens >= self.minimum
            if full and self.parts:
                yield from self._close(seed=True)
            self.parts.append((e["text"], n))
            self.tokens += n
            self.pages.update(pages)
            self.title, self.path, section = title or self.title, path or self.path, title or section
        yield from self._close(seed=False)

    def _reset(self) -> None:
        self.pages, self.title, self.path = set(), None, None

    def _close(self, seed: bool) -> Iterator[dict]:
        if self.parts:
            texts = [t for t, _ in self.parts]
            front = common_front(texts) if self.compound else ""
            yield self._chunk(texts, self.pages, f"{front} (Multiple subsections)" if front else self.title, self.path, "text")
        kept, held = [], 0
        for t, n in reversed(self.parts if seed and self.tokens > self.overlap else []):
            if held + n > self.overlap:
                break
            kept.insert(0, (t, n))
            held += n
        self.parts, self.tokens = kept, self.count(" ".join(t for t, _ in kept))
        self._reset()

    def _chunk(self, texts: list[str], pages: Iterable[int], title: str | None, path: str | None, kind: str) -> dict:
        body = "\n\n".join(texts)
        return {"text": body, "n_tokens": self.count(body), "page_numbers": sorted({int(p) for p in pages}), "chunk_type": kind, "section_title": title, "section_path": path}


def estimate(text: str) -> int:
    return len(text) // 4


def bpe_count(path: str) -> Callable[[str], int]:
    """A token counter by a vocabulary file of the tokenizers library, loaded once in each worker."""

    def count(text: str) -> int:
        if path not in _COUNTERS:
            from tokenizers import Tokenizer

            _COUNTERS[path] = Tokenizer.from_file(path)
        return len(_COUNTERS[path].encode(text, add_special_tokens=False).ids)

    return count


_COUNTERS: dict = {}


def pack_elements(elements: DataFrame, strategy: str = "section_aware", size: int = 350, overlap: int = 50, minimum: int = 200, maximum: int = 800, levels: int = 3, count: Callable[[str], int] = estimate) -> DataFrame:
    """``elements(doc_id, elem_idx, text, type, page_numbers, section_title, section_path)`` packed by document.

    ``semantic`` goes by size alone; ``section_aware`` breaks at major section changes too and never passes ``maximum``;
    ``hybrid`` also names chunks over several subsections by their common parent. A chunk takes the latest title and path of its own elements; overlap is
    whole trailing elements and is not credited. Sizes are sums of the elements' counts.

    Null and blank texts are passed over, null or empty pages are page 1, elements of equal ``elem_idx`` go by text; a null doc_id is one
    document. A document streams through one task.
    """
    if strategy not in ("semantic", "section_aware", "hybrid"):
        raise ValueError(f"unknown strategy {strategy!r}")
    packer = _Packer(size, overlap, minimum, maximum, levels, strategy != "semantic", strategy == "hybrid", count)
    names = ["doc_id", "elem_idx", "text", "type", "page_numbers", "section_title", "section_path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        out: list[dict] = []
        for doc, own in groupby(rows, key=lambda r: r["doc_id"]):
            for k, chunk in enumerate(packer.chunks(own)):
                out.append({"doc_id": doc, "chunk_index": k, **chunk})
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    whole, word = pa.int64(), pa.string()
    kinds = pa.schema([("doc_id", whole), ("chunk_index", whole), ("text", word), ("n_tokens", whole), ("page_numbers", pa.list_(pa.int32())), ("chunk_type", word), ("section_title", word), ("section_path", word)])
    real = elements.select(F.col("doc_id").cast("long").alias("doc_id"), *names[1:]).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return real.repartition("doc_id").sortWithinPartitions("doc_id", "elem_idx", "text").mapInArrow(run, _PACKED)


STRATEGIES = {
    "simple": lambda elements, **kw: fixed_windows(elements.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("elem_idx", "text"))), lambda e: e["text"]), "\n\n").alias("text")), **kw),
    "semantic": lambda elements, **kw: pack_elements(elements, "semantic", **kw),
    "section_aware": lambda elements, **kw: pack_elements(elements, "section_aware", **kw),
    "hybrid": lambda elements, **kw: pack_elements(elements, "hybrid", **kw),
}


def create_chunker(strategy: str, **params) -> Callable[[DataFrame], DataFrame]:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}: one of {sorted(STRATEGIES)}")
    return lambda elements: STRATEGIES[strategy](elements, **params)
