"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, materialize


def _print(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` undirected, any orderable type -> ``(u, v)``: every non-root vertex and its component's smallest vertex.

    Each round writes its edges to shared storage. Self loops are ignored; no edges give no rows.
    Vertices in no edge are their own component and do not appear.
    """
    now = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = _print(now)
    if not seen[0]:
        return now
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
        was, seen = seen, _print(now)
        if was == seen:
            return now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
