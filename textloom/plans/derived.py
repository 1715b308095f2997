"""Tables derived alike in Spark and in the oracles' SQL: a book of sections laid over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table

PAGE_CHARS = 3000
LINES = 40

SPEC = """spec AS (SELECT doc_id, doc_id // 1000 AS spec_id, text, n_chars, source, lang,
  concat_ws('.', 1 + (doc_id % 1000) // 100, 1 + (doc_id // 10) % 10, 1 + doc_id % 10) AS section_number, 'Sect ' || substr(md5(text), 1, 8) AS section_title,
  CAST(1 + coalesce(sum(CAST(ceil(n_chars / 3000.0) AS BIGINT)) OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_number
  FROM documents WHERE doc_id IS NOT NULL)"""
TOC = """tocline AS (SELECT spec_id, section_number, 1 + (doc_id % 1000) // 40 AS page_no, doc_id, section_number || ' ' || section_title || CASE doc_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' [7] .. ' ELSE ' ........ ' END || page_number AS line FROM spec),
toc AS (SELECT spec_id, page_no, string_agg(line, chr(10) ORDER BY doc_id) AS text FROM tocline GROUP BY ALL)"""
PAGES = """page AS (SELECT spec_id, page_number + i AS page_no, CASE WHEN i = 0 THEN section_number || ' ' || section_title || chr(10) ELSE '' END || substr(text, CAST(3000 * i + 1 AS BIGINT), 3000) AS text
  FROM (SELECT *, unnest(range(CAST(ceil(n_chars / 3000.0) AS BIGINT))) AS i FROM spec))"""
FOUND = """orig AS (SELECT spec_id, section_number, section_title, page_number, CAST(3 AS BIGINT) AS level, false AS inferred FROM spec),
pref AS (SELECT DISTINCT spec_id, array_to_string(string_split(section_number, '.')[1:i], '.') AS section_number, page_number FROM (SELECT *, unnest([1, 2]) AS i FROM orig)),
miss AS (SELECT spec_id, section_number, min(page_number) AS page_number FROM pref p WHERE NOT EXISTS (SELECT 1 FROM orig o WHERE o.spec_id = p.spec_id AND o.section_number = p.section_number) GROUP BY ALL),
every AS (SELECT * FROM orig UNION ALL SELECT spec_id, section_number, 'Section ' || section_number || ' [Inferred]', page_number, CAST(len(string_split(section_number, '.')) AS BIGINT), true FROM miss),
found AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY inferred, list_transform(string_split(section_number, '.'), lambda x: CAST(x AS INTEGER))) AS ord FROM every)"""
RANGES = """lastp AS (SELECT spec_id, max(page_no) AS last_page FROM page GROUP BY ALL),
rng AS (SELECT f.*, f.page_number AS page_start, greatest(f.page_number, coalesce(lead(f.page_number) OVER (PARTITION BY f.spec_id ORDER BY f.page_number, f.ord) - 1, last_page)) AS page_end FROM found f JOIN lastp USING (spec_id))"""


def spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    w = Window.partitionBy("spec_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    n_pages = F.ceil(F.col("n_chars") / F.lit(float(PAGE_CHARS))).cast("long")
    number = F.concat_ws(".", F.expr("1 + (doc_id % 1000) div 100"), F.expr("1 + (doc_id div 10) % 10"), F.expr("1 + doc_id % 10"))
    d = d.withColumn("spec_id", F.expr("doc_id div 1000")).withColumn("n_pages", n_pages)
    return d.select(
        "doc_id", "spec_id", "text", "n_chars", "source", "lang", "n_pages", number.alias("section_number"), F.concat(F.lit("Sect "), F.substring(F.md5("text"), 1, 8)).alias("section_title"),
        (1 + F.coalesce(F.sum("n_pages").over(w), F.lit(0))).cast("long").alias("page_number"),
    )


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.when(F.col("doc_id") % 5 == 0, "  ").when(F.col("doc_id") % 5 == 1, " [7] .. ").otherwise(" ........ ")
    line = F.concat("section_number", F.lit(" "), "section_title", gap, F.col("page_number").cast("string"))
    rows = spec(spark, sf_dir).select("spec_id", F.expr(f"1 + (doc_id % 1000) div {LINES}").alias("page_no"), F.struct("doc_id", line.alias("line")).alias("l"))
    return rows.groupBy("spec_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spec(spark, sf_dir).where("n_pages > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pages") - 1)).alias("i"))
    head = F.when(F.col("i") == 0, F.concat("section_number", F.lit(" "), "section_title", F.lit("\n"))).otherwise("")
    return rows.select("spec_id", (F.col("page_number") + F.col("i")).alias("page_no"), F.concat(head, F.substring("text", (F.col("i") * PAGE_CHARS + 1).cast("int"), F.lit(PAGE_CHARS))).alias("text"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spec(spark, sf_dir).select("spec_id", "section_number", "section_title", "page_number", F.lit(3).cast("long").alias("level"))
