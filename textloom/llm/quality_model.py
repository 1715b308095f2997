"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's score is the logistic function of ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``. The pairwise term is read off in linear time as
``(|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2``. Features are whole-text word counts, hashed into ``BUCKETS``, and one-hot bins of how the text is made up (letters
in capitals, symbols, repeats, word and line lengths, ...) and of the metadata column ``n_chars``. Nothing else of a row is an input.

The machine is fitted on a bounded sample of labelled rows: rounds of AdaGrad steps, by several tasks on parts of the sample, whose models are averaged by rows.
Scoring reads every whole text of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import ALNUM, pieces, text_bytes, words
from .runtime import look_up, materialize, releasing

#: Labelled rows that a model is fitted on, about, however many there are.
FIT_ROWS = 20_000
#: One labelled row in so many is held out.
HOLD_OUT = 5
THRESHOLD = 0.3
BUCKETS, RANK = 1 << 14, 8
ROUNDS, PARTS, ROWS_A_PART, STEP_ROWS = 6, 8, 2_500, 32
RATE, DECAY = 0.1, 1e-5

#: Bytes counted apart: capitals, small letters, digits, blanks, line ends, symbols, marks of exclamation, other punctuation, parts of longer characters, the rest.
_KIND = np.full(256, 9, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 0, 1, 2, 8
_KIND[list(b" \t\r\x0b\x0c")], _KIND[10], _KIND[list(b"#*$%&|<>")], _KIND[list(b"!?")], _KIND[list(b".,;:'\"()-")] = 3, 4, 5, 6, 7
_SHARES = np.array([0, 0.001, 0.003, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.6])
_SIZES = 2.0 ** np.arange(0, 20)
#: The statistics by place, and the edges of their bins.
_EDGES = [_SHARES] * 10 + [_SHARES] * 3 + [np.array([1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 8, 10, 15]), _SIZES, _SIZES, _SIZES]
_FIRST = BUCKETS + np.cumsum([0] + [len(e) + 1 for e in _EDGES])
FEATURES = int(_FIRST[-1])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of ``HOLD_OUT``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HOLD_OUT == 0


def _features(data: np.ndarray, off: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some whole texts: the first place of each, and its features and their values. Every text has all statistics, so none is without features."""
    n, size = len(off) - 1, np.maximum(np.diff(off), 1)
    kinds = np.stack([np.diff(np.concatenate([[0], np.cumsum(_KIND[data] == k)])[off]) for k in range(10)])
    h, start, end, at = words(data, off, ALNUM)
    n_words = np.diff(at)
    doc = np.repeat(np.arange(n), n_words)
    found, tf = np.unique(doc * BUCKETS + (h >> np.uint64(64 - 14)).astype(np.int64), return_counts=True)
    owner = found // BUCKETS
    distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, tf)
    again = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n) if len(h) else np.zeros(n)
    letters = np.bincount(doc, weights=end - start, minlength=n)
    some = np.maximum(n_words, 1)
    stats = [*(kinds / size), 1 - distinct / some, top / some, again / some, letters / some, n_words, size / (kinds[4] + 1), n_chars]
    binned = np.stack([first + np.searchsorted(edges, x, "left" if k < 13 else "right") for k, (first, edges, x) in enumerate(zip(_FIRST, _EDGES, stats))])
    value = np.log1p(tf)
    value /= np.sqrt(np.bincount(owner, weights=value * value, minlength=n))[owner]
    rows = np.concatenate([owner, np.tile(np.arange(n), len(binned))])
    index = np.concatenate([found % BUCKETS, binned.ravel()])
    value = np.concatenate([value, np.full(binned.size, 0.5)])
    order = np.argsort(rows, kind="stable")
    return np.searchsorted(rows[order], np.arange(n)), index[order].astype(np.int32), value[order].astype(np.float32)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Features of a batch's texts, some texts at a time."""
    data, off = text_bytes(batch.column("text"))
    n_chars = batch.column("n_chars").to_numpy(zero_copy_only=False).astype(np.float64)
    n_chars = np.where(np.isnan(n_chars), np.diff(off), n_chars)
    for i, j in pieces(off):
        yield i, j, *_features(data[off[i] : off[j]], off[i : j + 1] - off[i], n_chars[i:j])


class Machine:
    """``bias``, ``linear[feature]`` and ``pairs[feature, rank]``."""

    def __init__(self, seed: int = 11):
        self.bias, self.linear = np.zeros(1, np.float32), np.zeros(FEATURES, np.float32)
        self.pairs = np.random.default_rng(seed).normal(0, 0.02, (FEATURES, RANK)).astype(np.float32)

    def pack(self) -> bytes:
        return b"".join(x.tobytes() for x in (self.bias, self.linear, self.pairs))

    @staticmethod
    def unpack(packed: np.ndarray) -> Machine:
        m = Machine.__new__(Machine)
        flat = packed.astype(np.float32)
        m.bias, m.linear, m.pairs = flat[:1].copy(), flat[1 : FEATURES + 1].copy(), flat[FEATURES + 1 :].reshape(FEATURES, RANK).copy()
        return m

    def margins(self, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row: the sum before the logistic function, and ``sum v_i x_i``."""
        vx = self.pairs[index] * value[:, None]
        s = np.add.reduceat(vx, first)
        q = np.add.reduceat(np.einsum("if,if->i", vx, vx), first)
        return self.bias[0] + np.add.reduceat(self.linear[index] * value, first) + (np.einsum("rf,rf->r", s, s) - q) / 2, s

    def fit(self, first: np.ndarray, index: np.ndarray, value: np.ndarray, good: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
        """AdaGrad on the logistic loss, ``STEP_ROWS`` rows a step."""
        ends, n = np.append(first[1:], len(index)), len(first)
        seen = [np.full_like(x, 1e-6) for x in (self.bias, self.linear, self.pairs)]
        for _ in range(epochs):
            order = rng.permutation(n)
            for k in range(0, n, STEP_ROWS):
                rows = order[k : k + STEP_ROWS]
                size = ends[rows] - first[rows]
                at = np.cumsum(size) - size
                places = np.arange(size.sum()) - np.repeat(at - first[rows], size)
                i, x = index[places], value[places]
                y, s = self.margins(at, i, x)
                g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - good[rows]) / len(rows)
                gx = np.repeat(g, size) * x
                own, slot = np.unique(i, return_inverse=True)
                up = np.zeros((len(own), 1 + RANK))
                np.add.at(up, slot, np.concatenate([gx[:, None], gx[:, None] * (np.repeat(s, size, axis=0) - self.pairs[i] * x[:, None])], axis=1))
                for held, param, grad, where in ((seen[0], self.bias, np.array([g.sum()]), slice(None)), (seen[1], self.linear, up[:, 0], own), (seen[2], self.pairs, up[:, 1:], own)):
                    grad = grad + DECAY * param[where]
                    held[where] += grad * grad
                    param[where] -= RATE * grad / np.sqrt(held[where])


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    off = column.offsets.to_numpy()
    return off[:-1] - off[0], column.flatten().to_numpy()


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """A machine fitted on about ``fit_rows`` labelled rows, chosen by a hash of their id; none that is held out.

    Labels without an id or a quality are left out; a document of several labels is bad if any says so. Without labels the machine scores 0.5.
    """
    marks = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("good"))
    n = marks.count()
    if n > fit_rows:
        marks = marks.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) < round(fit_rows / n * (1 << 20)))
    marks = materialize(marks, "marks")
    rows = look_up(docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars")), marks).where("good is not null")

    def extract(batches):
        for batch in batches:
            parts = [(np.append(first, len(index)), index, value) for _, _, first, index, value in _texts(batch)]
            if not parts:
                continue
            sizes = np.concatenate([np.diff(p[0]) for p in parts])
            off = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(np.concatenate([p[k] for p in parts]))) for k in (1, 2)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("good"), *lists], names=["doc_id", "good", "index", "value"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    table = materialize(rows.mapInArrow(releasing(extract), f"doc_id {kinds['doc_id']}, good int, index array<int>, value array<float>"), "features")
    n, machine = table.count(), Machine()
    parts = min(PARTS, max(1, n // ROWS_A_PART))
    table = table.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    for k in range(ROUNDS * (n > 0)):
        sent = table.sparkSession.sparkContext.broadcast(machine.pack())
        fitted = table.groupBy("part").applyInArrow(_fit_part(sent, k), "part int, n long, model binary").collect()
        fitted.sort(key=lambda r: r["part"])
        machine = Machine.unpack(np.average([np.frombuffer(r["model"], np.float32) for r in fitted], axis=0, weights=[r["n"] for r in fitted]))
        sent.destroy()
    return machine


def _fit_part(sent, k: int):
    """Round ``k`` of one part of the sample, from the model sent."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        m, good, part = Machine.unpack(np.frombuffer(sent.value, np.float32)), t.column("good").to_numpy(), t.column("part")[0].as_py()
        first, index = _ragged(t.column("index"))
        m.fit(first, index, _ragged(t.column("value"))[1], good, min(10, max(2, 1920 // len(good))), np.random.default_rng([k, part]))
        return pa.table({"part": pa.array([part], pa.int32()), "n": [len(good)], "model": pa.array([m.pack()], pa.binary())})

    return run


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row, repeated rows too. Null text counts as empty; an empty text has the score of its statistics.

    A null ``n_chars`` counts as the text's bytes. Extra columns are not read. Empty tables give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine.pack())
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        m = Machine.unpack(np.frombuffer(sent.value, np.float32))
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, first, index, value in _texts(batch):
                out[i:j] = 1 / (1 + np.exp(-np.clip(m.margins(first, index, value)[0].astype(np.float64), -30, 30)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars")).mapInArrow(releasing(run), f"doc_id {kinds['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on the labelled rows that are not held out, score all rows."""
    return score(docs, fit(docs, labels, fit_rows), threshold)
