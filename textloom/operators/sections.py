"""Correction and validation of chunks' section titles: by a caller's model, or by rules that stand in for one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .plugs import with_results

CORRECTION = "section_title string, section_path string, confidence double, reasoning string"
VALIDATION = "is_match boolean, relevance_score double, content_summary string, expected_section string, mismatch_reason string, confidence double"
LOW_RELEVANCE = 0.7


def _first_line(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return F.nullif(F.trim(F.substring(F.trim(F.get(lines, F.lit(0))), 1, 60)), F.lit(""))


def correct(chunks: DataFrame, corrector: Callable[[dict], dict] | None = None, selective: bool = True) -> DataFrame:
    """``chunks(text, section_title, section_path, ...)`` with both corrected, and ``correction_confidence`` and ``correction_error`` added.

    ``selective``: only titles that ``needs_correction`` are asked about, the others keep theirs and a null confidence. ``corrector`` gets a chunk (its
    text cut to head and tail) and gives any of ``section_title``, ``section_path``, ``confidence``; what it leaves out stays, at 0.5. If it fails, the chunk
    stays as it is, at 0, with the error. Without one, the text's first line is its title, at 0.8 (none: unchanged, at 0).
    """
    asked = T.needs_correction("section_title") if selective else F.lit(True)
    if corrector is None:
        line = _first_line(F.col("text"))
        found = chunks.withColumn("_c", F.when(asked, F.struct(F.coalesce(line, "section_title").alias("section_title"), F.col("section_path"), F.when(line.isNull(), 0.0).otherwise(0.8).alias("confidence"))))
        found = found.withColumn("_c_error", F.lit(None).cast("string"))
    else:
        # chunks that are not asked about stay out of the workers
        ask = chunks.withColumn("_asked", asked)
        cut = ask.where("_asked").withColumn("_text", F.col("text")).withColumn("text", T.head_and_tail("text"))
        done = with_results(cut, corrector, CORRECTION, "_c").withColumn("text", F.col("_text")).drop("_text")
        done = done.withColumn("_c", F.struct(F.coalesce("_c.section_title", "section_title").alias("section_title"), F.coalesce("_c.section_path", "section_path").alias("section_path"), F.when(F.col("_c_error").isNotNull(), 0.0).otherwise(F.coalesce("_c.confidence", F.lit(0.5))).alias("confidence")))
        rest = ask.where("NOT _asked").withColumn("_c", F.lit(None).cast(done.schema["_c"].dataType)).withColumn("_c_error", F.lit(None).cast("string"))
        found = done.unionByName(rest).drop("_asked")
    out = found.withColumns({"section_title": F.coalesce("_c.section_title", "section_title"), "section_path": F.coalesce("_c.section_path", "section_path"), "correction_confidence": F.col("_c.confidence"), "correction_error": F.col("_c_error")})
    return out.drop("_c", "_c_error")


def correction_stats(corrected: DataFrame, *by: str) -> DataFrame:
    """``(total, corrected, skipped, failed)``; chunks whose correction raised count as failed."""
    asked, failed = F.col("correction_confidence").isNotNull(), F.col("correction_error").isNotNull()
    return corrected.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(asked & ~failed).alias("corrected"), F.count_if(~asked).alias("skipped"), F.count_if(failed).alias("failed"))


def validate(chunks: DataFrame, validator: Callable[[dict], dict] | None = None) -> DataFrame:
    """``chunks(text, section_title, ...)`` with ``is_match``, ``relevance_score``, ``expected_section``, ``validation_confidence`` and ``validation_error``.

    ``validator`` gets a chunk (its text cut at the end) and gives any of these; what it leaves out is false or 0. If it fails ``is_match`` is null and the rest 0.
    Without one, the relevance is the share of the title's words that are in the text, and half of them match; a title without words is not relevant.
    """
    if validator is None:
        title, body = F.array_distinct(T.tokens("section_title")), T.tokens("text")
        share = F.coalesce(F.try_divide(F.size(F.array_intersect(title, body)), F.size(title)), F.lit(0.0))
        out = chunks.withColumn("_v", F.struct((share >= 0.5).alias("is_match"), F.round(share, 6).alias("relevance_score"), F.when(share < 0.5, _first_line(F.col("text"))).alias("expected_section"), F.lit(1.0).alias("confidence")))
        out = out.withColumn("_v_error", F.lit(None).cast("string"))
    else:
        cut = chunks.withColumn("_text", F.col("text")).withColumn("text", T.head("text"))
        out = with_results(cut, validator, VALIDATION, "_v").withColumn("text", F.col("_text")).drop("_text")
    good = F.col("_v_error").isNull()
    out = out.withColumns({
        "is_match": F.when(good, F.coalesce("_v.is_match", F.lit(False))), "relevance_score": F.coalesce("_v.relevance_score", F.lit(0.0)), "expected_section": F.col("_v.expected_section"),
        "validation_confidence": F.coalesce("_v.confidence", F.lit(0.0)), "validation_error": F.col("_v_error"),
    })
    return out.drop("_v", "_v_error")


def validation_stats(validated: DataFrame, *by: str, threshold: float = LOW_RELEVANCE) -> DataFrame:
    """``(total, validated, matches, mismatches, low_relevance, errors)``; a null match is an error."""
    m = F.col("is_match")
    return validated.groupBy(*by).agg(
        F.count("*").alias("total"), F.count("*").alias("validated"), F.count_if(m).alias("matches"), F.count_if(~m).alias("mismatches"), F.count_if(F.col("relevance_score") < threshold).alias("low_relevance"), F.count_if(m.isNull()).alias("errors")
    )


def needs_review(relevance="relevance_score", match="is_match") -> Column:
    return (F.coalesce(F.col(relevance), F.lit(0.0)) < LOW_RELEVANCE) | ~F.coalesce(F.col(match), F.lit(False))


def low_relevance(validated: DataFrame, most: int = 10) -> DataFrame:
    """The ``most`` least relevant chunks below the threshold, for a report; ties by chunk_id."""
    return validated.where(F.col("relevance_score") < LOW_RELEVANCE).orderBy("relevance_score", "chunk_id").limit(most)


def assure(chunks: DataFrame, corrector: Callable[[dict], dict] | None = None, validator: Callable[[dict], dict] | None = None, auto_fix: bool = True) -> DataFrame:
    """Correct every chunk, validate the result, and mark what ``needs_review``: with ``auto_fix`` its title becomes the one that the validator
    expects (``auto_fixed``); without one to take, or without ``auto_fix``, it is left to ``needs_manual_review``."""
    done = validate(correct(chunks, corrector, selective=False), validator).withColumn("needs_review", needs_review())
    fix = F.col("needs_review") & F.lit(auto_fix) & (F.coalesce("expected_section", F.lit("")) != "")
    out = done.withColumns({"auto_fixed": fix, "needs_manual_review": F.col("needs_review") & ~fix})
    return out.withColumn("section_title", F.when(F.col("auto_fixed"), F.col("expected_section")).otherwise(F.col("section_title")))
