"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a text when a statistic passes a cutoff of a fixed grid. In each stratum (language) a quarter of the good labelled texts
and all bad ones put the cutoffs in order: those that reject fewest good texts first, then most bad ones; a cutoff that adds nothing to
those before it stays out. The other good texts tell how many of them the first cutoffs of that order reject together. Those are taken,
as many as go, whose exact one-sided binomial (Clopper-Pearson) upper bound of the false rejection rate, of all rules combined, is at most
``max_false_rejection``. The order does not depend on the texts it is tested on and the counts only grow along it, so no correction
over rules or grid points is due (fixed sequence); the level is ``alpha`` divided by the strata that can be certified at all, so that with
probability 1 - alpha no stratum loses more than ``max_false_rejection`` of its good texts to them, of those that the base rules leave. About 300 good labels suffice if none is
rejected (of four strata: 217 tested, 290 in all); with fewer, nothing is certified and the rules are off in that stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, tidy

SPACE = r"[\x20\x09-\x0D]+"
#: Rule -> (statistic, +1 rejects above the cutoff, -1 below it; grid).
RULES: dict[str, tuple[str, int, tuple[float, ...]]] = {
    "symbols": ("1e3 * n_symbols / greatest(word_chars, 1)", 1, (5, 10, 20, 40, 80, 150, 300)),
    "dup_lines": ("1e2 * n_dup_lines / greatest(n_words, 1)", 1, (0.25, 0.5, 1, 2, 4, 8, 16)),
    "repeats": ("1e2 * n_repeat_words / greatest(n_words, 1)", 1, (1, 2, 4, 6, 8, 12, 16)),
    "long_words": ("1e0 * word_chars / greatest(n_words, 1)", 1, (6, 7, 8, 9, 10, 12, 15)),
    "short_words": ("1e0 * word_chars / greatest(n_words, 1)", -1, (2, 2.5, 3, 3.5, 4, 4.5, 5)),
}
MAX_FALSE_REJECTION = 0.02
ALPHA = 0.05
#: One good label in so many puts the cutoffs in order; the others certify.
ORDERING_PART = 4


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body's lambdas refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(hashes: Column) -> Column:
    """Words covered by windows whose hash is there twice or more. Sorting happens only in texts that repeat a window."""

    def covered(pairs: Column) -> Column:
        near = lambda e, k: (F.get(pairs, k - 1)["h"] == e["h"]) | (F.get(pairs, k + 1)["h"] == e["h"])
        again = F.filter(pairs, lambda e, k: F.coalesce(near(e, k), F.lit(False)))
        places = F.sort_array(F.transform(again, lambda e: e["i"]))
        start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(5), x - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_bind(pairs, covered))


def statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """``(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)`` of every whole text; null: no words.

    ``carry``: the row's own columns too, in the struct ``row``.
    """
    text = F.coalesce("text", F.lit(""))
    bare = F.trim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r")) != "")

    def windows(h: Column) -> Column:
        at = F.when(F.size(h) >= 5, F.sequence(F.lit(0), F.size(h) - 5)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))

    def of_words(h: Column) -> Column:
        return F.struct(F.size(h).cast("long").alias("n_words"), _bind(windows(h), _repeated).alias("n_repeat_words"))

    own = [F.struct(*docs.columns).alias("row")] if carry else []
    stats = docs.select(
        *own,
        F.col("doc_id"),
        F.coalesce("lang", F.lit("")).alias("stratum"),
        _bind(F.transform(words, lambda w: F.xxhash64(w)), of_words).alias("w"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    stats = stats.select(*["row"] * carry, "doc_id", "stratum", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")
    return stats.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed in logarithms from the recurrence of its terms."""
    odds, none = F.lit(p / (1 - p)), n * F.log(F.lit(1 - p))

    def step(a, i):
        term = a["term"] + F.log((n - i + 1) / i * odds)
        top = F.greatest(a["sum"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(a["sum"], term) - top))).alias("sum"))

    ks = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(ks, F.struct(none.alias("term"), none.alias("sum")), step, lambda a: a["sum"]))


def certified_cutoffs(stats: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, alpha: float = ALPHA) -> DataFrame:
    """``(stratum, <rule> double ...)``: the cutoff each rule takes, null where none is certified.

    Labels without an id or a quality are left out; a document of several labels counts as bad if any is.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    held = stats.where("not base_failed").join(marks, "doc_id")
    passes = lambda x, sign, c: (F.expr(x) > c) if sign > 0 else (F.expr(x) < c)
    tests = [(name, x, sign, float(c)) for name, (x, sign, grid) in RULES.items() for c in grid]
    fails = [passes(x, sign, c).alias(f"f{k}") for k, (_, x, sign, c) in enumerate(tests)]
    part = F.when(~F.col("good"), "bad").when(F.pmod(F.xxhash64("doc_id"), F.lit(ORDERING_PART)) == 0, "order").otherwise("test")
    held = materialize(held.select("stratum", part.alias("part"), F.array(*fails).alias("fails")), "holdout")
    n_of = lambda p: F.count_if(F.col("part") == p)
    by_rule = [F.struct(F.lit(k).alias("test"), F.lit(-t[2] * t[3]).alias("loose"), F.count_if(F.col("fails")[k] & (F.col("part") == "order")).alias("k_good"), F.count_if(F.col("fails")[k] & (F.col("part") == "bad")).alias("k_bad")) for k, t in enumerate(tests)]
    totals = held.groupBy("stratum").agg(n_of("order").alias("n_order"), n_of("bad").alias("n_bad"), n_of("test").alias("n_test"), F.array(*by_rule).alias("tests"))
    # The order of the tests, from other texts than those that certify.
    useful = lambda good, bad: (bad > 0) & (bad * F.col("n_order") > good * F.col("n_bad"))
    ordered = F.array_sort(F.transform(F.filter("tests", lambda t: useful(t["k_good"], t["k_bad"])), lambda t: F.struct(t["k_good"], -t["k_bad"], t["loose"], t["test"].alias("test"))))
    totals = materialize(totals.select("stratum", "n_order", "n_bad", "n_test", F.transform(ordered, lambda t: t["test"]).alias("chain")), "totals")

    def along(chains: DataFrame) -> DataFrame:
        """For each place of a chain, the texts of each part that its test is the first to reject."""
        at = F.array_min(F.filter(F.transform("chain", lambda t, i: F.when(F.get("fails", t), i)), lambda i: i.isNotNull()))
        first = held.join(F.broadcast(chains.select("stratum", "chain")), "stratum").withColumn("at", at).where("at is not null")
        first = first.groupBy("stratum", "at").agg(*[n_of(p).alias(f"k_{p}") for p in ("order", "bad", "test")])
        places = chains.select("stratum", "n_order", "n_bad", "n_test", F.posexplode("chain").alias("at", "test"))
        return places.join(first, ["stratum", "at"], "left").fillna(0, ["k_order", "k_bad", "k_test"])

    adds = along(totals).where(useful(F.col("k_order"), F.col("k_bad")))
    chains = adds.groupBy("stratum", "n_order", "n_bad", "n_test").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "test"))), lambda t: t["test"]).alias("chain"))
    chains = materialize(chains.where(F.pow(F.lit(1 - max_false_rejection), "n_test") <= alpha), "chains")
    level = alpha / max(1, chains.count())
    upto = Window.partitionBy("stratum").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = along(chains).withColumn("lost", F.sum("k_test").over(upto))
    sure = F.when(F.col("lost") < max_false_rejection * F.col("n_test"), binomial_cdf(F.col("lost"), F.col("n_test"), max_false_rejection) <= level).otherwise(False)
    tightest = lambda r, sign: (F.min if sign > 0 else F.max)(F.when(F.col("test").isin([k for k, t in enumerate(tests) if t[0] == r]), F.element_at(F.array(*[F.lit(t[3]) for t in tests]), F.col("test") + 1)))
    return rows.where(sure).groupBy("stratum").agg(*[tightest(r, sign).alias(r) for r, (_, sign, _) in RULES.items()])


def judge(docs: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, alpha: float = ALPHA, carry: bool = False) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` -> the statistics of every row, ``base_failed``, ``failed_rules`` and ``kept``.

    A row per input row, repeated rows too. Null text: no words, so rejected. Null language: a stratum of its own ('').
    A null doc_id is judged by its stratum's cutoffs like any other. ``carry`` adds the struct ``row`` of the row's own columns. Extra columns are not read. Empty tables give no rows.
    """
    tidy(docs.sparkSession)
    stats = materialize(statistics(docs, carry), "statistics")
    cutoffs = materialize(certified_cutoffs(stats, labels, max_false_rejection, alpha), "cutoffs")
    failed = [F.when((F.expr(x) - F.col(r)) * sign > 0, F.lit(r)) for r, (x, sign, _) in RULES.items()]
    judged = stats.join(cutoffs, "stratum", "left").withColumn("failed_rules", F.array_compact(F.array(*failed)))
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return judged.withColumn("kept", kept).drop(*RULES)


def keep_good(docs: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, alpha: float = ALPHA) -> DataFrame:
    """The documents that are kept, columns as they come. Each row goes by its own verdict, whether or not it has an id or shares it."""
    return judge(docs, labels, max_false_rejection, alpha, carry=True).where("kept").select("row.*")
