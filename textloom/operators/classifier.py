"""A multinomial naive Bayes classifier of texts, fitted by aggregation; and classification by a function of the caller's."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from .plugs import with_results

#: Labelled rows that a model is fitted on, about, however many there are.
FIT_ROWS = 1_000_000


def fit(examples: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, DataFrame]:
    """``examples(text, label)`` -> ``(label, prior, unseen)`` and ``(term, label, gain)``.

    ``prior`` is the logarithm of a label's share of the rows, ``unseen`` that of the probability of a word that the label never had, ``gain`` what a word that it had adds
    to that, all with one count added to each word. Rows without a label are left out, null texts are rows without words. More than ``fit_rows`` rows are thinned by a hash of their text.
    """
    rows = examples.where("label is not null").select(F.col("label").cast("string").alias("label"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    if n > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("text", F.lit("fit")), F.lit(1 << 20)) < int(fit_rows / n * (1 << 20)))
    words = rows.select("label", F.explode(T.tokens("text")).alias("term")).groupBy("term", "label").agg(F.count("*").alias("n"))
    words = written(words, "words")
    size = words.agg(F.countDistinct("term").alias("v"))  # one row
    totals = words.groupBy("label").agg(F.sum("n").alias("total"))
    labels = rows.groupBy("label").agg(F.count("*").alias("rows")).join(totals, "label", "left").join(F.broadcast(size))
    every = F.sum("rows").over(Window.partitionBy(F.lit(0)))  # a row for each label
    labels = labels.select("label", (F.log("rows") - F.log(every)).alias("prior"), (-F.log(F.coalesce("total", F.lit(0)) + F.col("v") + F.lit(0.0))).alias("unseen"))
    return written(labels, "labels"), written(words.select("term", "label", F.log(F.col("n") + 1.0).alias("gain")), "gains")


def scores(texts: DataFrame, model: tuple[DataFrame, DataFrame], *ids: str) -> DataFrame:
    """``texts(<ids>, text)`` -> ``(<ids>, label, score)`` for every row and label, rounded to 6 places. Words that no label had count for none. ``ids`` tell the rows apart."""
    labels, gains = model
    known = gains.select("term").distinct()
    words = texts.select(*ids, F.explode(T.tokens("text")).alias("term")).groupBy(*ids, "term").agg(F.count("*").alias("times")).join(known, "term", "left_semi")
    words = written(words, "asked")
    size = words.groupBy(*ids).agg(F.sum("times").alias("size"))
    gained = words.join(gains, "term").groupBy(*ids, "label").agg(F.sum(F.col("times") * F.col("gain")).alias("gained"))
    rows = texts.select(*ids).join(F.broadcast(labels))  # a row for each label
    same = lambda other, names: [rows[c].eqNullSafe(other[c]) for c in names]
    out = rows.join(size, same(size, ids), "left").select(rows["*"], F.coalesce("size", F.lit(0)).alias("size"))
    found = out.join(gained, [out[c].eqNullSafe(gained[c]) for c in (*ids, "label")], "left")
    score = out["prior"] + out["size"] * out["unseen"] + F.coalesce(gained["gained"], F.lit(0.0))
    return found.select(*[out[c] for c in ids], out["label"], F.round(score, 6).alias("score"))


def classify(texts: DataFrame, model: tuple[DataFrame, DataFrame], *ids: str) -> DataFrame:
    """``(<ids>, label, score)``: the best label of each row, the first by name of equal ones."""
    best = F.max_by(F.struct("label", "score"), F.struct("score", (-F.col("place")).alias("place")))
    place = F.dense_rank().over(Window.partitionBy(*ids).orderBy("label"))
    return scores(texts, model, *ids).withColumn("place", place).groupBy(*ids).agg(best.alias("b")).select(*ids, "b.label", "b.score")


def by_caller(rows: DataFrame, call: Callable[[dict], str], categories: Sequence[str], column: str = "category") -> DataFrame:
    """Rows with ``<column>``, one of the categories as ``call`` says of a row; the first one where it fails or says another thing, and ``<column>_error`` where it fails."""
    out = with_results(rows, lambda r: {"said": call(r)}, "said string", "_said")
    said = F.lower(F.trim("_said.said"))
    return out.withColumn(column, F.when(said.isin(*categories), said).otherwise(categories[0])).withColumnRenamed("_said_error", f"{column}_error").drop("_said")
