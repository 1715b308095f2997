"""Which words of an answer its sources hold: each sentence is aligned with the hits that it cites by their longest common runs of words.

A sentence's sources become one suffix automaton over words, in which the sentence is followed word by word; the longest run that ends at each word gives the spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Shorter runs support nothing, and sentences with less of their words in runs are not supported.
LEAST_RUN, LEAST_SHARE = 3, 0.5
_ALIGNED = "query_id long, sentence_no int, sentence string, cited array<long>, n_words int, n_supported int, spans array<struct<first:int,last:int>>"


class WordAutomaton:
    """The suffix automaton of some lists of words; no run goes across two lists."""

    def __init__(self, texts: list[list[str]]):
        self.next: list[dict[str | None, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for words in texts:
            for w in [*words, None]:  # nothing that is asked for equals the end of a list
                last = self._extend(last, w)

    def _extend(self, last: int, word) -> int:
        new, at = self._state({}, self.length[last] + 1), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
            return new
        to = self.next[at][word]
        if self.length[to] != self.length[at] + 1:
            twin = self._state(dict(self.next[to]), self.length[at] + 1)
            self.link[twin], self.link[to] = self.link[to], twin
            while at >= 0 and self.next[at].get(word) == to:
                self.next[at][word] = twin
                at = self.link[at]
            to = twin
        self.link[new] = to
        return new

    def _state(self, edges: dict, length: int) -> int:
        self.next.append(edges)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def runs(self, words: list[str]) -> list[int]:
        """The length of the longest run of the lists that ends at each word."""
        out, at, n = [], 0, 0
        for w in words:
            while at and w not in self.next[at]:
                at = self.link[at]
                n = self.length[at]
            if w in self.next[at]:
                at, n = self.next[at][w], n + 1
            else:
                n = 0
            out.append(n)
        return out


def spans(runs: list[int], least: int = LEAST_RUN) -> list[tuple[int, int]]:
    """The words (first, last) that lie in runs of ``least`` words or more, neighbours joined."""
    out: list[tuple[int, int]] = []
    for end, n in enumerate(runs):
        if n >= least:
            first = end - n + 1
            while out and out[-1][1] >= first - 1:
                first = min(first, out.pop()[0])
            out.append((first, end))
    return out


def aligned(answers: DataFrame, hits: DataFrame, least_run: int = LEAST_RUN, least_share: float = LEAST_SHARE) -> DataFrame:
    """``answers(query_id, answer)``, ``hits(query_id, rank, text)`` -> ``(query_id, sentence_no, sentence, cited, n_words, n_supported, spans, share, is_supported)``, a row for each sentence.

    Words are compared in small letters without citations and punctuation at their edges. A sentence that cites nothing is held against all hits of its query; citations beyond the hits give
    nothing. Sentences without words are left out; null answers and texts have none.
    """
    parts = answers.select("query_id", F.posexplode(T.sentences(F.coalesce("answer", F.lit("")))).alias("sentence_no", "sentence")).withColumn("cited", T.citations("sentence"))
    sources = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text")))).alias("found"))
    rows = parts.join(sources, "query_id", "left")
    own = F.filter("found", lambda h: (F.size("cited") == 0) | F.array_contains("cited", h["rank"]))
    words = lambda c: F.filter(F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")
    rows = rows.select("query_id", "sentence_no", "sentence", "cited", words(F.regexp_replace("sentence", r"\[\d+\]", " ")).alias("words"), F.coalesce(F.transform(own, lambda h: words(h["text"])), F.array().cast("array<array<string>>")).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [spans(WordAutomaton(texts).runs(w), least_run) for w, texts in zip(batch.column("words").to_pylist(), batch.column("texts").to_pylist())]
            n_words = pa.array([len(w) for w in batch.column("words").to_pylist()], pa.int32())
            n_held = pa.array([sum(b - a + 1 for a, b in m) for m in made], pa.int32())
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            held = pa.array([[{"first": a, "last": b} for a, b in m] for m in made], kind)
            yield pa.record_batch([*(batch.column(c) for c in ("query_id", "sentence_no", "sentence", "cited")), n_words, n_held, held], names=["query_id", "sentence_no", "sentence", "cited", "n_words", "n_supported", "spans"])

    out = rows.where(F.size("words") > 0).mapInArrow(run, _ALIGNED)
    share = F.round(F.col("n_supported") / F.col("n_words"), 6)
    return out.withColumns({"share": share, "is_supported": share >= least_share})


def validated(answers: DataFrame, hits: DataFrame, least_run: int = LEAST_RUN, least_share: float = LEAST_SHARE) -> DataFrame:
    """``(query_id, supported, unsupported, is_valid)``: the share of an answer's words that its sources hold, its sentences that they do not, and whether there are none of those."""
    rows = aligned(answers, hits, least_run, least_share).groupBy("query_id").agg(
        F.round(F.sum("n_supported") / F.sum("n_words"), 6).alias("supported"),
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_supported"), F.struct("sentence_no", "sentence")))), lambda s: s["sentence"]).alias("unsupported"),
    )
    rows = answers.select("query_id").join(rows, "query_id", "left")
    none = F.array().cast("array<string>")
    return rows.select("query_id", F.coalesce("supported", F.lit(0.0)).alias("supported"), F.coalesce("unsupported", none).alias("unsupported"), (F.col("supported").isNotNull() & (F.size(F.coalesce("unsupported", none)) == 0)).alias("is_valid"))
