"""Mixing sources to target weights by entropy balancing.

Every document starts from one copy of the two it may have at most. Among all rates r in (0, 2) under which each
source's expected tokens meet its target, the one of least relative entropy to the start is
r = 2 / (1 + exp(-lambda_source * size / mean size)): rates are tilted exponentially in size (in the odds, which
keeps them below 2). The dual is one convex problem for each source; its Newton steps are kept inside a bracket
and run for all sources at once over the counts of (source, size), never on the driver. Rates become whole
copies by carrying what each document's fraction leaves owed on to the next of its bucket, from the largest down,
so that a source's total misses its target by about half of a small document for each bucket.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import BROADCAST_BYTES, ROW_BYTES, discard, materialize, tidy

SPACE = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Documents rounded in one task, about.
BUCKET_ROWS = 4_000


def _size(text: Column) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)``: words of every whole text; null: 0."""
    return docs.select("doc_id", "source", _size(F.col("text")).alias("size"))


def targets(by_source: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, total)``, a row per source -> also ``target``: ``share`` of all tokens, by weights that repeat in the sources' order
    (null last), none above ``most`` times its total. The level at which capped sources drop out is read off running sums in the
    order of cap to weight."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("weight", weight).withColumn("cap", F.col("total") * float(most))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    upto = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("budget", share * F.sum("total").over(everything))
    # if exactly those of smaller ratio are capped, the others stand at this level
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("nth", F.row_number().over(Window.orderBy("ratio", F.col("source").isNull(), "source")))
    # the first source that its level does not cap
    rows = rows.withColumn("theta", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(everything)["level"])
    target = F.when(F.col("theta").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("theta") * F.col("weight")))
    return rows.select("source", "total", target.alias("target"))


def _rate(lam: Column, x: Column, most: int) -> Column:
    return F.when(lam.isNull(), F.lit(float(most))).otherwise(F.lit(float(most)) / (1 + F.exp(F.least(F.lit(700.0), -lam * x))))


def tilts(histogram: DataFrame, goals: DataFrame, most: int = MOST, rounds: int = 500) -> DataFrame:
    """``histogram(source, size, n)``, ``goals(source, total, target, mean)`` -> ``goals`` with ``lam``; null: the full rate.

    Newton steps from the tilt that equal sizes would need, inside a bracket that first doubles outwards; a source stops within half a token or 1e-9
    of its target, or where its bracket is as narrow as numbers get. Raises if a source has not stopped after ``rounds`` (brackets halve, so none should).
    """
    same = F.col("h.source").eqNullSafe(F.col("g.source"))
    done = F.col("target") >= F.col("total") * float(most) * (1 - 1e-12)
    state = goals.select(
        "source", "total", "target", "mean",
        F.when(done, F.lit(None)).when(F.col("target") > 0, F.log(F.col("target") / (F.col("total") * float(most) - F.col("target")))).otherwise(F.lit(0.0)).cast("double").alias("lam"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), (done | (F.col("total") == 0)).alias("ok"),
    )
    state = materialize(state, "tilts")
    # decimal sums do not depend on the order of the rows, so reruns agree to the last bit
    exact = lambda v: F.sum(v.cast("decimal(38,9)")).cast("double")
    for _ in range(rounds):
        x = F.col("size") / F.col("mean")
        r = _rate(F.col("lam"), x, most)
        sums = histogram.alias("h").join(state.where("not ok").alias("g"), same).groupBy("g.source").agg(
            exact(F.col("n") * F.col("size") * r).alias("have"), exact(F.col("n") * F.col("size") * x * r * (1 - r / most)).alias("slope")
        )
        new = state.alias("g").join(sums.alias("h"), same, "left").select("g.*", "have", "slope")
        over = F.col("have") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        near = F.abs(F.col("have") - F.col("target")) <= F.greatest(F.lit(0.5), 1e-9 * F.col("target"))
        near = near | F.coalesce(F.col("hi") - F.col("lo") <= 1e-15 * F.greatest(F.lit(1.0), F.abs("lam")), F.lit(False))
        new = new.withColumn("stop", F.col("ok") | F.coalesce(near, F.lit(True)))
        new = new.withColumn("lo", F.when(F.col("stop"), F.col("lo")).otherwise(lo)).withColumn("hi", F.when(F.col("stop"), F.col("hi")).otherwise(hi))
        newton = F.col("lam") + (F.col("target") - F.col("have")) / F.greatest(F.col("slope"), F.lit(1e-300))
        far = F.greatest(F.lit(1.0), 2 * F.abs(F.col("lam")))
        bounded = (
            F.when(F.col("lo").isNull(), F.greatest(newton, F.col("hi") - far))
            .when(F.col("hi").isNull(), F.least(newton, F.col("lo") + far))
            .when((newton > F.col("lo")) & (newton < F.col("hi")), newton)
            .otherwise((F.col("lo") + F.col("hi")) / 2)
        )
        lam = F.when(F.col("stop"), F.col("lam")).otherwise(bounded)
        before, state = state, materialize(new.select("source", "total", "target", "mean", lam.alias("lam"), "lo", "hi", F.col("stop").alias("ok")), "tilts")
        discard(before)
        if state.where("not ok").isEmpty():
            return state.select("source", "total", "target", "mean", "lam")
    raise RuntimeError(f"tilts did not settle in {rounds} rounds")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``docs(doc_id, source, text)`` -> ``(doc_id, source, size, source_size, target, rate, copies, taken)``, a row per input row.

    ``copies`` is 0 to ``most``, ``taken`` = copies x size. A null source is one more source, last in order. Null and
    empty texts have size 0 and copies 1. Repeated rows count each for itself; equal rows may get different copies.
    The order that rounding follows is fixed by size, doc_id and a hash, so reruns agree. Empty tables give no rows.
    """
    tidy(docs.sparkSession)
    sized = materialize(sizes(docs), "sizes")
    histogram = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    by_source = materialize(
        histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("total"), F.sum("n").alias("rows")), "sources"
    )
    goals = targets(by_source.select("source", "total"), weights, share, most)
    goals = goals.alias("g").join(by_source.alias("b"), F.col("g.source").eqNullSafe(F.col("b.source"))).select("g.*", "rows", F.greatest(F.lit(1e-9), F.col("g.total") / F.col("rows")).alias("mean"))
    goals = materialize(goals, "goals")
    lam = tilts(histogram, goals.drop("rows"), most)
    tidy(docs.sparkSession)
    goals = materialize(lam.alias("l").join(goals.select("source", "rows").alias("g"), F.col("l.source").eqNullSafe(F.col("g.source"))).select("l.*", "rows"), "goals")
    rows = sized.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select(
        F.col("d.doc_id").cast("long").alias("doc_id"), "d.source", "d.size", F.col("total").alias("source_size"), "target", _rate(F.col("lam"), F.col("d.size") / F.col("mean"), most).alias("rate"),
        F.ceil(F.col("rows") / BUCKET_ROWS).alias("buckets"),
    )
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), "buckets"))
    out = "doc_id long, source string, size long, source_size long, target double, rate double, copies long, taken long"
    return rows.groupBy("source", "bucket").applyInArrow(_round(most), out)


def _round(most: int):
    """Whole copies for a bucket, from the largest document down: a document takes its fraction as a copy where half of its size
    or more is owed by then, so that what stays owed at the end is about half of a small document."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending")])
        owed, copies = 0.0, []
        for size, rate in zip(table["size"].to_pylist(), table["rate"].to_pylist()):
            whole = min(most, int(rate))
            owed += (rate - whole) * size
            if size and whole < most and owed >= size / 2:
                whole, owed = whole + 1, owed - size
            copies.append(whole if size else 1)
        n = pa.array(copies, pa.int64())
        names = ["doc_id", "source", "size", "source_size", "target", "rate"]
        return pa.table([*(table[c] for c in names), n, pc.multiply(n, table["size"])], names=[*names, "copies", "taken"])

    return run


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The documents as often as the mix takes them, columns as they come.

    Rows of one doc_id (or none), source and size share the copies that they got together: each has the whole part of an even share, and a hash of its text
    says which have one more, so that with many such rows their sum is met nearly.
    """
    doc = F.col("doc_id").cast("long")
    key = [F.xxhash64(doc, "source", doc.isNull(), F.col("source").isNull(), size) for size in ("size", _size(F.col("text")))]
    picked = mix(docs, weights, share, most).groupBy(key[0].alias("key")).agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).where("copies <> n")
    picked = materialize(picked.select(F.col("key").alias("__mix_key"), F.col("n").alias("__mix_n"), F.col("copies").alias("__mix_copies")), "copies")
    picked = F.broadcast(picked) if picked.count() <= BROADCAST_BYTES // ROW_BYTES else picked.hint("shuffle_merge")
    found = docs.join(picked, key[1] == F.col("__mix_key"), "left")
    one_more = F.pmod(F.xxhash64("text", F.lit("share")), F.col("__mix_n")) < F.col("__mix_copies") % F.col("__mix_n")
    times = F.coalesce(F.floor(F.col("__mix_copies") / F.col("__mix_n")) + F.when(one_more, 1).otherwise(0), F.lit(1)).cast("long")
    times = F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<bigint>"))
    return found.withColumn("__mix_copies", F.explode(times)).select(*[docs[c] for c in docs.columns])
