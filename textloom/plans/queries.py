"""The registered queries and, beside each, the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, block_index, chunking, classifier, intervals, retrieval, sections, store, toc, vector_index
from ..session import shared_folder, written
from ..sources import page_files, tables
from ..sources.tables import table
from . import derived
from .derived import FOUND, PAGES, RANGES, SPEC, TOC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _docs(s, d):
    return table(s, d, "documents")


# --- vectors

_VEC = """v AS (SELECT q.vec_id AS query_id, b.vec_id, b.label, round(list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM v)"""


def _vector(s, d, k):
    e = table(s, d, "embeddings")
    return retrieval.vector_topk(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k)


@query(f"WITH {_VEC} SELECT query_id, vec_id, score, rank FROM vr WHERE rank <= 10")
def q_vector_topk(s, d):
    return _vector(s, d, 10)


@query(f"WITH {_VEC} SELECT query_id, vec_id, score, rank FROM vr WHERE rank <= 10 AND score >= 0.25")
def q_min_score_after_topk(s, d):
    return _vector(s, d, 10).where("score >= 0.25D")


@query(f"""WITH {_VEC}, t AS (SELECT *, count(*) OVER (PARTITION BY query_id, label) AS n FROM vr WHERE rank <= 10), u AS (SELECT *, round(score * (1 + CAST(0.15 AS DOUBLE) * (n - 1)) + CAST(1e-9 AS DOUBLE), 6) AS new_score FROM t)
SELECT query_id, vec_id, rank, new_score, row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC, rank) AS new_rank FROM u""")
def q_rerank_section(s, d):
    hits = _vector(s, d, 10).join(table(s, d, "embeddings").select("vec_id", "label"), "vec_id")
    return retrieval.rerank_by_section(hits, "label").select("query_id", "vec_id", "rank", "new_score", "new_rank")


@query("SELECT count(*) AS n, CAST(max(len(embedding)) AS BIGINT) AS dim, count(DISTINCT label) AS labels FROM embeddings")
def q_collection_info(s, d):
    return table(s, d, "embeddings").agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("dim"), F.countDistinct("label").alias("labels"))


@query("""WITH w AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS t FROM benchmark),
b AS (SELECT item_id, CAST(concat('0x', substr(md5(t), 1, 7)) AS BIGINT) % 64 AS k FROM w)
SELECT item_id, k AS bucket, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY ALL""")
def q_hashed_vector(s, d):
    v = table(s, d, "benchmark").select("item_id", F.posexplode(retrieval.hashed_vector("text")).alias("bucket", "n"))
    return v.where("n > 0").select("item_id", F.col("bucket").cast("long").alias("bucket"), "n")


def _vector_index(s, d) -> vector_index.VectorIndex:
    """The index over the vectors of a folder: built once in a session, in the shared folder."""
    key = s.sparkContext.applicationId, d
    if key not in _VECTOR_INDEXES:
        _VECTOR_INDEXES[key] = vector_index.VectorIndex.build(table(s, d, "embeddings"), f"{shared_folder(s)}/textloom/vectors-{uuid.uuid4().hex}")
    return _VECTOR_INDEXES[key]


_VECTOR_INDEXES: dict[tuple, vector_index.VectorIndex] = {}


@query(f"WITH {_VEC} SELECT query_id, vec_id, score, rank FROM vr WHERE rank <= 10")
def q_vector_index(s, d):
    """All cells probed, all their vectors scored: the exact hits. What fewer probes and codes find of them is measured in the tests."""
    asked = table(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return _vector_index(s, d).search(asked, 10, probes=None, candidates=None)


@query("SELECT CAST(page_id // 40 AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY page_id // 40 ORDER BY page_id) AS INTEGER) AS page_no, md5(translate(coalesce(html, ''), chr(12) || chr(13), ' ' || chr(10))) AS text_md5 FROM pages")
def q_page_files(s, d):
    """All pages, written as files of 40 pages and read back by the data source, a task a file."""
    n = F.row_number().over(Window.partitionBy(F.expr("page_id div 40")).orderBy("page_id"))
    folder = f"{shared_folder(s)}/textloom/page-files-{uuid.uuid4().hex}"
    page_files.write(table(s, d, "pages").select(F.expr("page_id div 40").cast("string").alias("doc_id"), n.alias("page_no"), F.col("html").alias("text")), folder)
    return page_files.read(s, folder).select("doc_id", "page_no", F.md5("text").alias("text_md5"))


# One pattern for each tag, as RE2 knows no references back.
_TAGGED = "(?s)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in tables.TAGS)


# --- text basics

_TOK = r"list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')"


@query(f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, {_TOK} AS w FROM documents)")
def q_tokenize_stats(s, d):
    w = _docs(s, d).select("doc_id", T.tokens("text").alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query("SELECT lang, count(*) FILTER (WHERE length(text) // 4 <= 800) AS within, count(*) FILTER (WHERE length(text) // 4 > 800) AS over, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def q_token_estimate(s, d):
    n = T.token_estimate("text")
    return _docs(s, d).groupBy("lang").agg(F.count_if(n <= 800).alias("within"), F.count_if(n > 800).alias("over"), F.sum(n).alias("tokens"))


@query("SELECT doc_id, translate(concat_ws('_', source, lang || ' 5.1', substr(md5(text), 1, 8)), '. ', '__') AS document_id, sha256(concat_ws(':', doc_id, 7)) AS chunk_id FROM documents")
def q_doc_id(s, d):
    return _docs(s, d).select("doc_id", T.document_id("source", F.concat("lang", F.lit(" 5.1")), "text").alias("document_id"), T.stable_id("doc_id", F.lit(7)).alias("chunk_id"))


_FIXED = f"""t AS (SELECT doc_id, {_TOK} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 50 - 1, 0) + 1, 300)) AS s, len(range(0, greatest(len(w) - 50 - 1, 0) + 1, 300)) AS total_chunks FROM t WHERE len(w) > 0),
chunk AS (SELECT doc_id, CAST(s // 300 AS BIGINT) AS chunk_index, total_chunks, CAST(len(w[s + 1:s + 350]) AS BIGINT) AS n_tokens, array_to_string(w[s + 1:s + 350], ' ') AS text FROM c)"""


@query(f"WITH {_FIXED} SELECT doc_id, chunk_index, total_chunks, n_tokens, md5(text) AS text_md5 FROM chunk")
def q_chunk_fixed(s, d):
    return chunking.fixed_windows(_docs(s, d)).select("doc_id", "chunk_index", "total_chunks", "n_tokens", F.md5("text").alias("text_md5"))


@query(f"WITH {_FIXED} SELECT count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, round(avg(length(text) // 4), 6) AS mean_tokens FROM chunk WHERE length(text) >= 50")
def q_chunk_stats(s, d):
    c, n = chunking.fixed_windows(_docs(s, d)).where(F.length("text") >= 50), T.token_estimate("text")
    return c.agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("chars"), F.sum(n).alias("tokens"), F.round(F.avg(n), 6).alias("mean_tokens"))


_TITLE = r"""t AS (SELECT doc_id, lang, source, text, split_part(coalesce(text, ''), chr(10), 1) AS title FROM documents),
nc AS (SELECT *, title = '' OR starts_with(title, 'Figure') OR starts_with(title, 'Table') OR title IN ('Tables', 'Figures', 'Contents') OR length(title) < 4 OR NOT regexp_matches(title, '\p{L}') OR len(list_filter(string_split_regex(title, '\s+'), lambda x: x <> '')) > 15 AS needs FROM t)"""


def _titles(s, d):
    return _docs(s, d).withColumn("title", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)).withColumn("needs", T.needs_correction("title"))


@query(f"WITH {_TITLE} SELECT doc_id, needs FROM nc")
def q_title_needs_correction(s, d):
    return _titles(s, d).select("doc_id", "needs")


@query(f"""WITH {_TITLE}, c AS (SELECT *, CASE WHEN needs THEN upper(lang) || ' ' || source END AS fixed, CASE WHEN length(text) > 2000 THEN 1000 + 1000 + 31 ELSE length(text) END AS sent FROM nc)
SELECT lang, count(*) AS total, count(*) FILTER (WHERE needs AND fixed IS NOT NULL) AS corrected, count(*) FILTER (WHERE NOT needs) AS skipped, count(*) FILTER (WHERE needs AND fixed IS NULL) AS failed, CAST(sum(sent) FILTER (WHERE needs) AS BIGINT) AS sent_chars FROM c GROUP BY lang""")
def q_selective_correction(s, d):
    rows = _titles(s, d).withColumn("fixed", F.when(F.col("needs"), F.concat(F.upper("lang"), F.lit(" "), "source"))).withColumn("sent", F.length(T.head_and_tail("text", 2000, "\n\n[... content truncated ...]\n\n")))
    need = F.col("needs")
    return rows.groupBy("lang").agg(
        F.count("*").alias("total"), F.count_if(need & F.col("fixed").isNotNull()).alias("corrected"), F.count_if(~need).alias("skipped"), F.count_if(need & F.col("fixed").isNull()).alias("failed"), F.sum(F.when(need, F.col("sent"))).alias("sent_chars")
    )


@query("SELECT count(DISTINCT split_part(coalesce(text, ''), chr(10), 1)) AS titles, count(DISTINCT source) AS sources FROM documents")
def q_unique_titles(s, d):
    return _titles(s, d).agg(F.countDistinct("title").alias("titles"), F.countDistinct("source").alias("sources"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[.!?]\s+')) AS breaks, regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g') AS marked FROM documents")
def q_sentences(s, d):
    parts = T.sentences("text")
    return _docs(s, d).select("doc_id", (F.size(parts) - 1).cast("long").alias("breaks"), F.array_join(parts, "\x01").alias("marked"))


# --- BM25 and fusion

_POST = rf"""w AS (SELECT doc_id, {_TOK} AS w FROM documents), dl AS (SELECT doc_id, len(w) AS dl FROM w), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), idf0 AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, st),
me AS (SELECT avg(raw) AS m FROM idf0), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * m ELSE raw END AS idf FROM idf0, me)"""
_BM25 = rf"""{_POST}, q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, tf.doc_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY ALL),
kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)"""


_INDEXES: dict[tuple, retrieval.Bm25Index] = {}


def _index(s, d) -> retrieval.Bm25Index:
    """The index over the documents of a folder: built once in a session, in the shared folder."""
    key = s.sparkContext.applicationId, d
    if key not in _INDEXES:
        _INDEXES[key] = retrieval.Bm25Index.build(_docs(s, d).select("doc_id", "text"), f"{shared_folder(s)}/textloom/bm25-{uuid.uuid4().hex}")
    return _INDEXES[key]


def _asked(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(s, d, k):
    return retrieval.bm25_topk(_index(s, d), _asked(s, d), k)


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM kr WHERE rank <= 10")
def q_bm25_batch(s, d):
    return _bm25(s, d, 10)


_BLOCKS: dict[tuple, block_index.BlockIndex] = {}


def _blocks(s, d) -> block_index.BlockIndex:
    key = s.sparkContext.applicationId, d
    if key not in _BLOCKS:
        _BLOCKS[key] = block_index.BlockIndex.build(_docs(s, d).select("doc_id", "text"), f"{shared_folder(s)}/textloom/blocks-{uuid.uuid4().hex}")
    return _BLOCKS[key]


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM kr WHERE rank <= 10")
def q_bm25_pruned(s, d):
    return _blocks(s, d).topk(_asked(s, d), 10)


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM kr WHERE query_id = 0 AND rank <= 20")
def q_bm25_topk(s, d):
    return retrieval.bm25_topk(_index(s, d), _asked(s, d).where("query_id = 0"), 20)


@query(f"WITH {_BM25}, f AS (SELECT sc.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc JOIN documents USING (doc_id) WHERE score > 0 AND source = 'src3') SELECT query_id, doc_id, score, rank FROM f WHERE rank <= 5")
def q_bm25_doc_filter(s, d):
    return retrieval.bm25_topk(_index(s, d), _asked(s, d), 5, _docs(s, d).where("source = 'src3'"))


_FEED = rf"""{_BM25}, hs AS (SELECT query_id, doc_id, score / sum(score) OVER (PARTITION BY query_id) AS share FROM kr WHERE rank <= 10),
hw AS (SELECT query_id, share, len(w) AS n, unnest(w) AS term FROM hs JOIN w USING (doc_id)), fw AS (SELECT query_id, term, round(sum(share / n), 9) AS fed FROM hw GROUP BY ALL),
fp AS (SELECT * FROM fw QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fed DESC, term) <= 10), qn AS (SELECT query_id, sum(times) AS n FROM q GROUP BY ALL),
ow AS (SELECT query_id, term, round(times::DOUBLE / n, 9) AS asked FROM q JOIN qn USING (query_id)),
ex AS (SELECT query_id, term, CASE WHEN query_id IN (SELECT query_id FROM fp) THEN 0.5::DOUBLE * coalesce(asked, 0) + 0.5::DOUBLE * coalesce(fed, 0) ELSE asked END AS times FROM ow FULL JOIN fp USING (query_id, term))"""


def _expanded(s, d):
    return retrieval.expanded(_asked(s, d), _bm25(s, d, 10), _docs(s, d).select("doc_id", "text"))


@query(f"WITH {_FEED} SELECT query_id, term, round(times + 1e-12::DOUBLE, 6) AS weight FROM ex WHERE times > 0")
def q_query_expansion(s, d):
    return _expanded(s, d).select("query_id", "term", F.round(F.col("times") + 1e-12, 6).alias("weight"))


@query(f"""WITH {_FEED}, es AS (SELECT query_id, tf.doc_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM ex JOIN tf USING (term) JOIN idf USING (term) JOIN dl ON dl.doc_id = tf.doc_id, st WHERE times > 0 GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM es WHERE score > 0 QUALIFY rank <= 10""")
def q_expanded_search(s, d):
    return retrieval.weighted_topk(_index(s, d), _expanded(s, d), 10)


_BAYES = rf"""ex AS (SELECT lang AS label, coalesce(text, '') AS text FROM documents WHERE lang IS NOT NULL), ew AS (SELECT label, unnest({_TOK}) AS term FROM ex), tn AS (SELECT term, label, count(*) AS n FROM ew GROUP BY ALL),
sz AS (SELECT count(DISTINCT term) AS v FROM tn), tt AS (SELECT label, sum(n) AS total FROM tn GROUP BY ALL),
lb AS (SELECT label, ln(count(*)) - ln((SELECT count(*) FROM ex)) AS prior FROM ex GROUP BY label), lm AS (SELECT label, prior, -ln((coalesce(total, 0) + v)::DOUBLE) AS unseen FROM lb LEFT JOIN tt USING (label), sz),
cw AS (SELECT conv_id, turn, term, count(*) AS times FROM (SELECT conv_id, turn, unnest({_TOK}) AS term FROM conversations) WHERE term IN (SELECT term FROM tn) GROUP BY ALL), cs AS (SELECT conv_id, turn, sum(times) AS size FROM cw GROUP BY ALL),
gn AS (SELECT conv_id, turn, label, sum(times * ln(n + 1.0::DOUBLE)) AS gained FROM cw JOIN tn USING (term) GROUP BY ALL),
sc AS (SELECT c.conv_id, c.turn, l.label, round(prior + coalesce(size, 0) * unseen + coalesce(gained, 0), 6) AS score FROM conversations c CROSS JOIN lm l LEFT JOIN cs ON cs.conv_id = c.conv_id AND cs.turn = c.turn LEFT JOIN gn ON gn.conv_id = c.conv_id AND gn.turn = c.turn AND gn.label = l.label)"""


@query(f"WITH {_BAYES} SELECT conv_id, turn, label, round(score, 4) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, label) = 1")
def q_naive_bayes(s, d):
    """Languages of the turns, by a model of the documents."""
    model = classifier.fit(_docs(s, d).select("text", F.col("lang").alias("label")))
    return classifier.classify(table(s, d, "conversations"), model, "conv_id", "turn").select("conv_id", "turn", "label", F.round("score", 4).alias("score"))


@query(f"WITH {_POST} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, round(m, 6) AS mean_idf FROM st, me")
def q_bm25_stats(s, d):
    return _index(s, d).stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"))


_RRF = f"""{_VEC}, {_BM25}, l AS (SELECT query_id // 100 AS query_id, vec_id AS doc_id, rank AS v, NULL AS k FROM vr WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, NULL, rank FROM kr WHERE rank <= 20),
fu AS (SELECT query_id, doc_id, max(v) AS v_rank, max(k) AS k_rank FROM l GROUP BY ALL), fs AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + v_rank), 0) + coalesce(1.0::DOUBLE / (60 + k_rank), 0), 9) AS score FROM fu),
rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, v_rank NULLS LAST, k_rank NULLS LAST) AS rank FROM fs)"""


def _legs(s, d, k=20):
    v = _vector(s, d, k).select(F.expr("query_id div 100").alias("query_id"), F.col("vec_id").alias("doc_id"), "rank")
    return v, _bm25(s, d, k).select("query_id", "doc_id", "rank")


@query(f"WITH {_RRF} SELECT query_id, doc_id, score, rank FROM rrf WHERE rank <= 10")
def q_rrf_fusion(s, d):
    return retrieval.rrf(*_legs(s, d), 10).select("query_id", "doc_id", "score", "rank")


@query(f"""WITH {_RRF}, h AS (SELECT r.query_id, r.doc_id, r.rank, r.score, count(*) OVER (PARTITION BY query_id, coalesce(nullif(source, ''), 'unknown')) AS n FROM rrf r JOIN documents USING (doc_id) WHERE rank <= 10),
u AS (SELECT *, round(score * (1 + CAST(0.15 AS DOUBLE) * (n - 1)) + CAST(1e-9 AS DOUBLE), 6) AS new_score FROM h) SELECT query_id, doc_id, new_score, row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC, rank) AS new_rank FROM u""")
def q_hybrid_search(s, d):
    hits = retrieval.small(written(retrieval.rrf(*_legs(s, d), 10), "fused"))
    hits = _docs(s, d).select("doc_id", "source").join(hits, "doc_id")
    return retrieval.rerank_by_section(hits, "source").select("query_id", "doc_id", "new_score", "new_rank")


@query(f"WITH {_RRF} SELECT query_id, doc_id FROM l WHERE v IS NOT NULL INTERSECT SELECT query_id, doc_id FROM l WHERE k IS NOT NULL")
def q_found_by_both(s, d):
    v, k = _legs(s, d)
    return v.select("query_id", "doc_id").intersect(k.select("query_id", "doc_id"))


# --- answers

_HIT = f"""{_VEC}, hit AS (SELECT query_id, rank, vec_id, score, coalesce(d.text, '') AS text, d.source || ' > ' || d.lang AS section_path, printf('%.1f%%', score * 100) AS pct FROM vr JOIN documents d ON d.doc_id = vr.vec_id WHERE rank <= 10)"""


def _hits(s, d):
    docs = _docs(s, d).select(F.col("doc_id").alias("vec_id"), F.coalesce("text", F.lit("")).alias("text"), F.concat("source", F.lit(" > "), "lang").alias("section_path"), F.array(F.col("doc_id") % 97).alias("pages"))
    return _vector(s, d, 10).join(docs, "vec_id")


@query(f"""WITH {_HIT}, a AS (SELECT *, '[' || rank || '] ' || section_path || ' (Page ' || (vec_id % 97) || ', Relevance: ' || pct || ')' AS head FROM hit WHERE rank <= 5),
b AS (SELECT *, 4000 - coalesce(sum(length(head) + length(text) + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM a)
SELECT query_id, string_agg(head || chr(10) || CASE WHEN length(text) > room THEN substr(text, 1, CAST(room AS BIGINT)) || '...' ELSE text END || chr(10), chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM b WHERE room > 0 GROUP BY query_id""")
def q_context_assembly(s, d):
    return retrieval.context(_hits(s, d))


_ANS = "ans AS (SELECT conv_id, turn, coalesce(text, '') || ' [' || (conv_id % 7 + 1) || '] see [' || (turn % 3) || '] and [' || (conv_id % 7 + 1) || ']' AS answer FROM conversations WHERE role = 'assistant')"
_CITE = r"list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: CAST(x AS BIGINT))"


def _answers(s, d):
    a = F.format_string("%s [%d] see [%d] and [%d]", F.coalesce("text", F.lit("")), F.col("conv_id") % 7 + 1, F.col("turn") % 3, F.col("conv_id") % 7 + 1)
    return table(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", a.alias("answer"))


@query(rf"WITH {_ANS}, c AS (SELECT conv_id, turn, unnest({_CITE}) AS n, generate_subscripts({_CITE}, 1) AS i FROM ans), f AS (SELECT conv_id, turn, n, min(i) AS i FROM c GROUP BY ALL) SELECT conv_id, turn, string_agg(CAST(n AS VARCHAR), ',' ORDER BY i) AS cited FROM f GROUP BY ALL")
def q_citation_extract(s, d):
    return _answers(s, d).select("conv_id", "turn", F.array_join(T.citations("answer"), ",").alias("cited"))


@query(rf"WITH {_HIT}, {_ANS}, c AS (SELECT DISTINCT conv_id, turn, unnest({_CITE}) AS number FROM ans) SELECT conv_id, turn, number, vec_id, substr(text, 1, 200) || '...' AS text_preview FROM c JOIN hit ON rank = number AND query_id = 100 * (conv_id % 7)")
def q_citation_join(s, d):
    cited = _answers(s, d).select("conv_id", "turn", F.explode(T.citations("answer")).alias("number"))
    cited = cited.withColumn("query_id", 100 * (F.col("conv_id") % 7))
    hits = _hits(s, d).select("query_id", F.col("rank").alias("number"), "vec_id", T.preview("text").alias("text_preview"))
    return cited.join(hits, ["query_id", "number"]).select("conv_id", "turn", "number", "vec_id", "text_preview")


@query(rf"""WITH {_VEC}, top AS (SELECT query_id // 100 AS k, rank, score AS sc FROM vr WHERE rank <= 10),
a AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN text || ' [1]' WHEN 1 THEN 'Unable to determine. ' || text ELSE text END AS answer FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, round(CASE WHEN sc IS NULL THEN 0 WHEN contains(lower(answer), 'i cannot answer') OR contains(lower(answer), 'not found in the context') OR contains(lower(answer), 'insufficient information') OR contains(lower(answer), 'context doesn''t contain') OR contains(lower(answer), 'unable to determine') THEN greatest(0.3::DOUBLE, sc * 0.5::DOUBLE)
  WHEN NOT regexp_matches(answer, '\[\d+\]') THEN greatest(0.4::DOUBLE, sc * 0.6::DOUBLE) ELSE least(1.0::DOUBLE, sc * 1.1::DOUBLE) END, 6) AS confidence FROM a LEFT JOIN top ON k = conv_id % 7 AND rank = 1 + turn % 10)
SELECT *, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS bucket FROM c""")
def q_confidence(s, d):
    top = _vector(s, d, 10).select(F.expr("query_id div 100").alias("k"), "rank", F.col("score").alias("sc"))
    a = F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit(" [1]"))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("Unable to determine. "), "text")).otherwise(F.col("text"))
    rows = table(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", a.alias("answer"), (F.col("conv_id") % 7).alias("k"), (1 + F.col("turn") % 10).cast("long").alias("rank")).join(top, ["k", "rank"], "left")
    rows = rows.select("conv_id", "turn", F.round(T.confidence("sc", "answer"), 6).alias("confidence"))
    return rows.withColumn("bucket", F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.6, "medium").otherwise("low"))


_CLASS = r"CASE WHEN regexp_matches(lower(text), '(^|\s)(compare|versus|vs|difference)') THEN 'comparison' WHEN regexp_matches(lower(text), '(^|\s)(error|fail|debug)') THEN 'troubleshooting' WHEN regexp_matches(lower(text), '(^|\s)(how|step)') THEN 'procedural' WHEN regexp_matches(lower(text), '(^|\s)(what is|define|meaning)') THEN 'definition' WHEN regexp_matches(lower(text), '(^|\s)(spec|value|maximum)') THEN 'specification' ELSE 'factual' END"
_ROUTES = ", ".join(f"('{a}', '{b}', CAST({c} AS BIGINT), CAST({'NULL' if m is None else m} AS DOUBLE))" for a, b, c, m in retrieval.ROUTES)


@query(f"WITH q AS (SELECT doc_id, {_CLASS} AS query_type FROM documents) SELECT doc_id, query_type, strategy, top_k, min_score FROM q JOIN (VALUES {_ROUTES}) r(query_type, strategy, top_k, min_score) USING (query_type)")
def q_route_params(s, d):
    return retrieval.route(_docs(s, d).select("doc_id", "text")).select("doc_id", "query_type", "strategy", "top_k", "min_score")


@query("SELECT e.event_id, coalesce(d.source || ' ' || d.lang, CAST(e.user_id AS VARCHAR)) AS shown FROM events e LEFT JOIN documents d ON d.doc_id = e.user_id * 30")
def q_doc_source(s, d):
    docs = _docs(s, d).select("doc_id", F.concat("source", F.lit(" "), "lang").alias("name"))
    e = table(s, d, "events").select("event_id", "user_id", (F.col("user_id") * 30).alias("doc_id"))
    return e.join(docs, "doc_id", "left").select("event_id", F.coalesce("name", F.col("user_id").cast("string")).alias("shown"))


@query(r"SELECT conv_id, turn, array_to_string(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{3,}')).list_sort(), ',') AS names FROM conversations")
def q_entities(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.array_join(answers.entities("text"), ",").alias("names"))


@query(rf"""WITH t AS (SELECT conv_id, turn, role, list_distinct({_TOK}) AS w, lead(list_distinct({_TOK})) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations)
SELECT conv_id, turn, round(CAST(len(list_intersect(w, a)) AS DOUBLE) / nullif(len(a), 0), 6) AS overlap FROM t WHERE role = 'user' AND a IS NOT NULL""")
def q_answer_overlap(s, d):
    w = F.array_distinct(T.tokens("text"))
    rows = table(s, d, "conversations").select("conv_id", "turn", "role", w.alias("w"), F.lead(w).over(Window.partitionBy("conv_id").orderBy("turn")).alias("a"))
    return rows.where("role = 'user' AND a IS NOT NULL").select("conv_id", "turn", F.round(F.try_divide(F.size(F.array_intersect("w", "a")), F.size("a")), 6).alias("overlap"))


@query("SELECT lang, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, round(sum(length(text) // 4) * 0.14::DOUBLE / 1000000 + count(*) * 100 * 0.28::DOUBLE / 1000000, 9) AS dollars FROM documents GROUP BY lang")
def q_cost_estimate(s, d):
    n = F.sum(T.token_estimate("text"))
    return _docs(s, d).groupBy("lang").agg(n.alias("tokens"), F.round(n * 0.14 / 1000000 + F.count("*") * 100 * 0.28 / 1000000, 9).alias("dollars"))


@query(r"""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM events""")
def q_json_fields(s, d):
    k = F.from_json("props", "k long")["k"]
    fenced = F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))
    both = F.coalesce(T.json_of_answer(fenced, "k long")["k"], F.lit(-1))
    return table(s, d, "events").select("event_id", F.when(both == k, k).alias("k"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("shown"))


# --- tables of contents

_PATS = " UNION ALL ".join(
    f"SELECT spec_id, page_no AS toc_page, CAST({k} AS BIGINT) AS pattern_used, unnest(regexp_extract_all(text, '{p}', 1)) AS section_number, unnest(regexp_extract_all(text, '{p}', 2)) AS title, CAST(unnest(regexp_extract_all(text, '{p}', 3)) AS BIGINT) AS page_number, unnest(range(len(regexp_extract_all(text, '{p}', 1)))) AS pos FROM toc"
    for k, p in enumerate(T.TOC_PATTERNS)
)
_ENTRY = rf"{SPEC}, {TOC}, raw AS ({_PATS}), entry AS (SELECT *, trim(regexp_replace(regexp_replace(trim(title), '\s*\.{{2,}}\s*', ' ', 'g'), '\s{{2,}}', ' ', 'g')) AS section_title, CAST(len(string_split(section_number, '.')) AS BIGINT) AS level FROM raw)"


@query(rf"""WITH {SPEC}, {TOC}, {PAGES}, u AS (SELECT spec_id, page_no, text, 'toc' AS kind FROM toc UNION ALL SELECT spec_id, page_no, text, 'body' FROM page)
SELECT spec_id, page_no, kind FROM u WHERE page_no <= 30 AND (contains(lower(text), 'contents') OR len(regexp_extract_all(text, '\.{{3,}}\s*\d+')) > 10 OR len(regexp_extract_all(text, '(?m)^\s*\d+\.\d+(?:\.\d+)?\s+[A-Z]')) > 5)""")
def q_toc_page_detect(s, d):
    both = derived.toc(s, d).withColumn("kind", F.lit("toc")).unionByName(derived.pages(s, d).withColumn("kind", F.lit("body")))
    return toc.toc_pages(both).select("spec_id", "page_no", "kind")


@query(f"WITH {_ENTRY} SELECT spec_id, toc_page, pattern_used, section_number, section_title, page_number, level FROM entry")
def q_toc_parse(s, d):
    return toc.entries(derived.toc(s, d)).drop("pos")


@query(f"WITH {_ENTRY} SELECT spec_id, section_number, section_title, page_number, pattern_used FROM entry QUALIFY row_number() OVER (PARTITION BY spec_id, section_number ORDER BY toc_page, pattern_used, pos) = 1")
def q_toc_dedupe(s, d):
    return toc.first_of_each(toc.entries(derived.toc(s, d))).select("spec_id", "section_number", "section_title", "page_number", "pattern_used")


@query(f"WITH {SPEC} SELECT spec_id, section_number, row_number() OVER (PARTITION BY spec_id ORDER BY list_transform(string_split(section_number, '.'), lambda x: CAST(x AS INTEGER))) AS nth FROM spec")
def q_section_sort(s, d):
    w = Window.partitionBy("spec_id").orderBy(T.section_key("section_number"))
    return derived.entries(s, d).select("spec_id", "section_number", F.row_number().over(w).cast("long").alias("nth"))


@query(f"WITH {SPEC}, {FOUND} SELECT * FROM miss")
def q_missing_parents(s, d):
    return toc.missing_parents(derived.entries(s, d))


@query(f"WITH {SPEC}, {FOUND} SELECT spec_id, section_number, section_title, page_number, level, inferred, ord FROM found")
def q_infer_parents(s, d):
    return toc.with_parents(derived.entries(s, d))


def _ranges(s, d):
    last = derived.pages(s, d).groupBy("spec_id").agg(F.max("page_no").alias("last_page"))
    return toc.page_ranges(toc.with_parents(derived.entries(s, d)), last)


_RNG = f"{SPEC}, {PAGES}, {FOUND}, {RANGES}"


@query(f"WITH {_RNG} SELECT spec_id, section_number, page_start, page_end, page_end - page_start + 1 AS page_count, page_end - page_start + 1 > 10 AS is_long FROM rng")
def q_page_ranges(s, d):
    return _ranges(s, d).select("spec_id", "section_number", "page_start", "page_end", "page_count", "is_long")


@query(f"WITH {_RNG}, r AS (SELECT spec_id, section_number, page_end - page_start + 1 AS page_count FROM rng) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY spec_id ORDER BY page_count DESC, section_number) <= 10")
def q_long_sections(s, d):
    w = Window.partitionBy("spec_id").orderBy(F.desc("page_count"), "section_number")
    return _ranges(s, d).withColumn("n", F.row_number().over(w)).where("n <= 10").select("spec_id", "section_number", "page_count")


@query(f"WITH {_RNG} SELECT spec_id, count(*) AS sections, round(avg(page_end - page_start + 1), 6) AS mean_pages, count(*) FILTER (WHERE page_end - page_start + 1 > 10) AS long, count(*) FILTER (WHERE page_end = page_start) AS one_page FROM rng GROUP BY spec_id")
def q_range_stats(s, d):
    return _ranges(s, d).groupBy("spec_id").agg(F.count("*").alias("sections"), F.round(F.avg("page_count"), 6).alias("mean_pages"), F.count_if("is_long").alias("long"), F.count_if(F.col("page_count") == 1).alias("one_page"))


@query(f"WITH {_RNG} SELECT r.spec_id, r.section_number, md5(string_agg(p.text, chr(10) || chr(10) ORDER BY p.page_no)) AS content_md5 FROM rng r JOIN page p ON p.spec_id = r.spec_id AND p.page_no BETWEEN r.page_start AND r.page_end GROUP BY ALL")
def q_range_content(s, d):
    found = tables.range_content(derived.pages(s, d), _ranges(s, d))
    return found.select("spec_id", "section_number", F.md5("content").alias("content_md5"))


_SUB = "section_number || '.1 Sub ' || substr(md5(text), 1, 6) || chr(10) || section_number || ' ' || section_title || chr(10) || section_number || '.2 Xy . ... 7' || chr(10) || section_number || '.3 Long  title ..... 12 '"


@query(rf"""WITH {_RNG}, sub AS (SELECT spec_id, page_number AS page_no, {_SUB} AS text FROM spec),
ln AS (SELECT spec_id, page_no, unnest(regexp_extract_all(text, '{T.SUBSECTION_LINE}', 1)) AS section_number, unnest(regexp_extract_all(text, '{T.SUBSECTION_LINE}', 2)) AS raw, unnest(range(len(regexp_extract_all(text, '{T.SUBSECTION_LINE}', 1)))) AS pos FROM sub),
ti AS (SELECT * EXCLUDE (raw), trim(regexp_replace(regexp_replace(raw, '\s*\.{{2,}}\s*\d+\s*$', ''), '\s{{2,}}', ' ', 'g')) AS section_title FROM ln),
par AS (SELECT spec_id, section_number AS parent, page_start, page_end FROM rng WHERE level <= 3 AND NOT inferred AND page_start <= page_end)
SELECT l.spec_id, parent, l.section_number, l.section_title, l.page_no AS page_number, CAST(len(string_split(l.section_number, '.')) AS BIGINT) AS level FROM ti l JOIN par p ON p.spec_id = l.spec_id AND p.parent = regexp_replace(l.section_number, '\.\d+$', '') AND l.page_no BETWEEN page_start AND page_end
WHERE length(section_title) >= 3 QUALIFY row_number() OVER (PARTITION BY l.spec_id, l.section_number ORDER BY l.page_no, pos) = 1""")
def q_bounded_subsections(s, d):
    """Lines of the fourth level belong to entries of the book; those of the third to inferred ones, which are not asked for any."""
    n = F.col("section_number")
    text = F.concat(n, F.lit(".1 Sub "), F.substring(F.md5("text"), 1, 6), F.lit("\n"), n, F.lit(" "), "section_title", F.lit("\n"), n, F.lit(".2 Xy . ... 7\n"), n, F.lit(".3 Long  title ..... 12 "))
    return toc.subsections(_ranges(s, d), derived.spec(s, d).select("spec_id", F.col("page_number").alias("page_no"), text.alias("text")))


@query(f"""WITH {SPEC}, {FOUND}, deep AS (SELECT * FROM found WHERE level > 1), px AS (SELECT spec_id, section_number, unnest(range(1, len(string_split(section_number, '.')) + 1)) AS i FROM deep),
pt AS (SELECT spec_id, section_number, i, array_to_string(string_split(section_number, '.')[1:i], '.') AS prefix FROM px)
SELECT pt.spec_id, pt.section_number, string_agg(prefix || coalesce(' ' || f.section_title, ''), ' → ' ORDER BY i) AS section_path FROM pt LEFT JOIN deep f ON f.spec_id = pt.spec_id AND f.section_number = pt.prefix GROUP BY ALL""")
def q_section_path(s, d):
    """The first level has no entry, so its number stands alone."""
    return toc.section_paths(toc.with_parents(derived.entries(s, d)).where("level > 1")).drop("section_title")


@query(f"""WITH {SPEC}, {FOUND}, pa AS (SELECT *, regexp_replace(section_number, '\\.[^.]*$', '') AS parent FROM found WHERE contains(section_number, '.'))
SELECT a.spec_id, a.section_number, count(*) AS related FROM pa a JOIN pa b ON a.spec_id = b.spec_id AND a.parent = b.parent AND a.section_number <> b.section_number GROUP BY ALL""")
def q_related_sections(s, d):
    own = toc.with_parents(derived.entries(s, d)).where(F.col("section_number").contains("."))
    own = own.select("spec_id", "section_number", F.regexp_replace("section_number", r"\.[^.]*$", "").alias("parent"))
    n = F.count("*").over(Window.partitionBy("spec_id", "parent"))
    return own.select("spec_id", "section_number", (n - 1).alias("related")).where("related > 0")


@query(f"""WITH {SPEC}, {FOUND}, c AS (SELECT spec_id, regexp_replace(section_number, '\\.[^.]*$', '') AS parent, section_number FROM found WHERE contains(section_number, '.'))
SELECT spec_id, parent, count(*) AS n, string_agg(section_number, ',' ORDER BY section_number) AS children FROM c GROUP BY ALL""")
def q_children(s, d):
    own = toc.with_parents(derived.entries(s, d)).where(F.col("section_number").contains("."))
    own = own.groupBy("spec_id", F.regexp_replace("section_number", r"\.[^.]*$", "").alias("parent")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("section_number")).alias("c"))
    return own.select("spec_id", "parent", "n", F.array_join("c", ",").alias("children"))


@query(rf"SELECT doc_id, coalesce(nullif(trim(regexp_extract(substr(text, 1, 500), '(?m)^[^\n]{{0,100}}?\"([^\"]{{2,50}})\"', 1)), ''), nullif(regexp_extract(substr(text, 1, 500), '(?m)^[^\n]{{0,100}}?\b([A-Z]{{2,}}[0-9]{{2,}})\b', 1), ''), list_filter(list_transform(string_split(substr(text, 1, 500), chr(10))[1:10], lambda x: trim(x)), lambda x: length(x) >= 5 AND length(x) <= 50 AND regexp_matches(x, '^\p{{Lu}}') AND NOT starts_with(x, '1.1') AND (NOT ends_with(x, '.') OR len(regexp_extract_all(x, ' ')) <= 5) AND NOT regexp_matches(x, '(?i)JEDEC Standard No\.|Page \d+|^\d+\s*$|Copyright|All rights reserved|^Table \d+|^Figure \d+|^\d+\.\d+'))[1]) AS subtitle FROM documents")
def q_subtitle(s, d):
    return _docs(s, d).select("doc_id", T.subtitle("text", F.lit("1.1")).alias("subtitle"))


_NOISY = r"'JEDEC Standard No. 84' || chr(10) || 'Page 12' || chr(10) || '6.6.2' || chr(10) || 'CSD (cont''d)' || chr(10) || '7.3.1 CSD_STRUCTURE [127:126]' || chr(10) || '6.6.2 Start  of' || chr(10) || chr(10) || chr(10) || chr(10) || coalesce(text, '') || ' JESD84-B51  43 ' || chr(10)"


@query(rf"""WITH n AS (SELECT doc_id, {_NOISY} AS t FROM documents),
l AS (SELECT doc_id, array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT (regexp_matches(trim(x), '(?i)^JEDEC Standard No\.') OR regexp_matches(trim(x), '(?i)^Page \d+$') OR regexp_matches(trim(x), '^JESD84-B\d+\s+\d+$') OR regexp_matches(trim(x), '^6\.6\.2\.?\s*$') OR (regexp_matches(trim(x), '(?i)\(cont[''‘’]?d\)') AND length(trim(x)) < 80 AND NOT ends_with(trim(x), '.')) OR regexp_matches(trim(x), '^\d+(\.\d+)+\s+[A-Z_]+(\s+\[[\d:]+\])?$'))), chr(10)) AS t FROM n)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^(?:[ \t]*\n)+', ''), '(?m)^\s*6\.6\.2\s+', '', 'g'), 'JESD84-B\d+\s+\d+', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS content_md5 FROM l""")
def q_clean_content(s, d):
    head = "JEDEC Standard No. 84\nPage 12\n6.6.2\nCSD (cont'd)\n7.3.1 CSD_STRUCTURE [127:126]\n6.6.2 Start  of\n\n\n\n"
    noisy = F.concat(F.lit(head), F.coalesce("text", F.lit("")), F.lit(" JESD84-B51  43 \n"))
    return _docs(s, d).select("doc_id", F.md5(T.clean_content(noisy, F.lit("6.6.2"))).alias("content_md5"))


@query(f"WITH {_RNG}, k AS (SELECT DISTINCT spec_id, unnest(range(page_start, page_end + 1)) AS page_no FROM rng WHERE level <= 2) SELECT spec_id, count(*) AS covered, max(last_page) AS total, round(100.0::DOUBLE * count(*) / max(last_page), 6) AS pct FROM k JOIN lastp USING (spec_id) GROUP BY spec_id")
def q_coverage(s, d):
    last = derived.pages(s, d).groupBy("spec_id").agg(F.max("page_no").alias("last_page"))
    got = intervals.covered(_ranges(s, d).where("level <= 2")).join(last.withColumnRenamed("last_page", "total"), "spec_id")
    return got.withColumn("pct", F.round(100.0 * F.col("covered") / F.col("total"), 6))


_OPEN = f"{_RNG}, k AS (SELECT DISTINCT spec_id, unnest(range(page_start, page_end + 1)) AS page_no FROM rng WHERE level <= 2), un AS (SELECT spec_id, page_no FROM page EXCEPT SELECT * FROM k)"


@query(f"WITH {_OPEN} SELECT * FROM un")
def q_uncovered_pages(s, d):
    return intervals.outside(derived.pages(s, d), _ranges(s, d).where("level <= 2"))


@query(f"WITH {_OPEN}, g AS (SELECT *, page_no - row_number() OVER (PARTITION BY spec_id ORDER BY page_no) AS g FROM un) SELECT spec_id, min(page_no) AS first_page, max(page_no) AS last_page FROM g GROUP BY spec_id, g")
def q_gap_islands(s, d):
    return intervals.islands(intervals.outside(derived.pages(s, d), _ranges(s, d).where("level <= 2")))


@query(f"WITH {SPEC}, {FOUND} SELECT spec_id, level, count(*) AS n, array_to_string(list(section_number ORDER BY ord)[1:3], ',') AS examples FROM found GROUP BY ALL")
def q_level_counts(s, d):
    own = toc.with_parents(derived.entries(s, d)).groupBy("spec_id", "level").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("ord", "section_number"))), 1, 3).alias("e"))
    return own.select("spec_id", "level", "n", F.array_join(F.transform("e", lambda x: x["section_number"]), ",").alias("examples"))


@query(f"WITH {SPEC}, {FOUND}, k AS (SELECT *, list_transform(string_split(section_number, '.'), lambda x: CAST(x AS INTEGER)) AS key FROM found), p AS (SELECT *, lag(section_number) OVER w AS previous, lag(key) OVER w AS pk FROM k WINDOW w AS (PARTITION BY spec_id ORDER BY page_number, ord)) SELECT spec_id, previous, section_number FROM p WHERE pk > key")
def q_out_of_order(s, d):
    return toc.out_of_order(toc.with_parents(derived.entries(s, d)))


@query(f"WITH {SPEC}, g AS (SELECT spec_id, regexp_replace(section_number, '\\.[^.]*$', '') AS parent, CAST(split_part(section_number, '.', 3) AS BIGINT) + CASE WHEN n_chars > 2000 THEN 5 ELSE 0 END AS last FROM spec), p AS (SELECT *, lag(last) OVER (PARTITION BY spec_id, parent ORDER BY last) AS previous FROM g) SELECT spec_id, parent, previous, last FROM p WHERE last <> previous + 1")
def q_sibling_gaps(s, d):
    """Long sections are renumbered, which leaves gaps and doubles."""
    last = F.split("section_number", r"\.")[2].cast("long") + F.when(F.col("n_chars") > 2000, 5).otherwise(0)
    return toc.sibling_gaps(derived.spec(s, d).select("spec_id", F.concat(F.regexp_replace("section_number", r"[^.]*$", ""), last).alias("section_number")))


@query(f"""WITH {SPEC}, {FOUND}, e AS (SELECT spec_id, section_number, CASE WHEN page_number % 9 = 0 THEN 'Sect' ELSE section_title END AS title, page_number, list_transform(string_split(section_number, '.'), lambda x: CAST(x AS INTEGER)) AS key FROM orig),
o AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY key) AS ord FROM e), p AS (SELECT spec_id, lag(key) OVER (PARTITION BY spec_id ORDER BY page_number, ord) > key AS bad, length(title) < 10 AS short FROM o),
i AS (SELECT spec_id, least(count(*) FILTER (WHERE short), 5) + least(count(*) FILTER (WHERE bad), 5) + least((SELECT count(*) FROM miss WHERE miss.spec_id = p.spec_id), 5) AS issues FROM p GROUP BY spec_id) SELECT spec_id, issues, greatest(0, 100 - 2 * issues) AS score FROM i""")
def q_toc_quality(s, d):
    """The book without its inferred parents, which are all missing; some titles are short."""
    title = F.when(F.col("page_number") % 9 == 0, "Sect").otherwise(F.col("section_title"))
    ord_ = F.row_number().over(Window.partitionBy("spec_id").orderBy(T.section_key("section_number")))
    return toc.toc_quality(derived.entries(s, d).withColumn("section_title", title).withColumn("ord", ord_))


@query(f"WITH {SPEC}, {FOUND} SELECT spec_id, section_number, page_number FROM found UNION ALL SELECT spec_id, section_number || '.1', page_number FROM spec")
def q_union_toc(s, d):
    extra = derived.spec(s, d).select("spec_id", F.concat("section_number", F.lit(".1")).alias("section_number"), "page_number")
    return toc.with_parents(derived.entries(s, d)).select("spec_id", "section_number", "page_number").unionByName(extra)


@query(f"""WITH {SPEC}, t AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'Figure 6-' || doc_id WHEN 1 THEN 'table 6-' || doc_id WHEN 2 THEN 'Appendix B.1' WHEN 3 THEN 'Chapter ' || doc_id WHEN 4 THEN section_number || ' ' || section_title WHEN 5 THEN 'B.2 Overview' WHEN 6 THEN '7 Of' WHEN 7 THEN 'ab' ELSE section_title END AS t FROM spec)
SELECT doc_id, CAST(CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 1 WHEN 7 THEN NULL ELSE 2 END AS BIGINT) AS level,
  CASE doc_id % 9 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 2 THEN 'appendix' WHEN 4 THEN 'section' ELSE 'other' END AS kind FROM t""")
def q_heading_classes(s, d):
    k = F.col("doc_id") % 9
    made = ((0, F.concat(F.lit("Figure 6-"), "doc_id")), (1, F.concat(F.lit("table 6-"), "doc_id")), (2, F.lit("Appendix B.1")), (3, F.concat(F.lit("Chapter "), "doc_id")), (4, F.concat("section_number", F.lit(" "), "section_title")), (5, F.lit("B.2 Overview")), (6, F.lit("7 Of")), (7, F.lit("ab")))
    t = F.col("section_title")
    for n, own in made:
        t = F.when(k == n, own).otherwise(t)
    return derived.spec(s, d).select("doc_id", T.heading_level(t).cast("long").alias("level"), T.heading_class(t).alias("kind"))


@query(f"WITH {SPEC}, {FOUND}, t AS (SELECT spec_id, section_number, CASE WHEN level = 1 THEN upper(left(section_title, 7)) WHEN level = 2 THEN 'CSD_' || page_number ELSE section_title END AS t FROM found) SELECT spec_id, count(*) FILTER (WHERE length(t) < 10) AS short, count(*) FILTER (WHERE upper(t) = t AND lower(t) <> t) AS capitals, count(*) FILTER (WHERE regexp_full_match(t, '[A-Z0-9_]+')) AS register FROM t GROUP BY spec_id")
def q_title_flaws(s, d):
    t = F.when(F.col("level") == 1, F.upper(F.substring("section_title", 1, 7))).when(F.col("level") == 2, F.concat(F.lit("CSD_"), "page_number")).otherwise(F.col("section_title"))
    flaws = toc.with_parents(derived.entries(s, d)).select("spec_id", T.title_flaws(t).alias("f"))
    return flaws.groupBy("spec_id").agg(*[F.count_if(f"f.{c}").alias(c) for c in ("short", "capitals", "register")])


@query(f"""WITH {SPEC}, {PAGES}, h AS (SELECT spec_id, page_no, regexp_matches(text, '(?m)^\\s*(\\d+\\.[\\d\\.]+)\\s+([A-Z][^\\n]{{0,200}})') AS headed FROM page), c AS (SELECT spec_id, count(*) AS total, count(*) FILTER (WHERE headed) AS headed, round(100.0::DOUBLE * count(*) FILTER (WHERE headed) / count(*), 6) AS pct FROM h GROUP BY spec_id)
SELECT *, CASE WHEN pct >= 95 THEN 'HIGH' WHEN pct >= 80 THEN 'MEDIUM' ELSE 'LOW' END AS feasibility, CASE WHEN pct >= 95 THEN 'PROCEED' WHEN pct >= 85 THEN 'CONSIDER' ELSE 'STAY' END AS proceed FROM c""")
def q_headed_coverage(s, d):
    return toc.headed_coverage(derived.pages(s, d))


@query(f"WITH {SPEC}, {PAGES} SELECT spec_id, page_no FROM page WHERE text <> '' AND NOT regexp_matches(text, '(?m)^\\s*(\\d+\\.[\\d\\.]+)\\s+([A-Z][^\\n]{{0,200}})')")
def q_unheaded_pages(s, d):
    return toc.unheaded_pages(derived.pages(s, d))


@query(f"""WITH {SPEC} SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'Recovered ' || substr(md5(text), 1, 6) WHEN 5 THEN 'CSDX' WHEN 7 THEN 'Title of it' END AS title FROM spec""")
def q_recovered_title(s, d):
    """A title in its place; then what each rule rejects: lower case, a page, colons, too short; capitals may be short; too long; a continuation loses its mark."""
    after = (F.concat(F.lit("Recovered "), F.substring(F.md5("text"), 1, 6), F.lit(".\nbody")), F.lit("lower case\n"), F.lit("Page 12 of it\n"), F.lit("Row: a: b\n"), F.lit("Abcd\n"), F.lit("CSDX\n"), F.concat(F.lit("L"), F.repeat(F.lit("x"), 80), F.lit("\n")), F.lit("Title of it (cont'd)\n"))
    own = F.concat(F.lit("x\n"), "section_number", F.lit("  "), F.element_at(F.array(*after), (F.col("doc_id") % 8 + 1).cast("int")))
    return derived.spec(s, d).select("doc_id", T.recovered_title(own, "section_number").alias("title"))


_MIXED = "CASE doc_id % 5 WHEN 0 THEN 'Introduction' WHEN 1 THEN section_number || '.' || (1 + doc_id % 3) || ' ' || lang WHEN 2 THEN 'B.' || (doc_id // 10) || ' ' || lang WHEN 3 THEN section_number || '.1.1 ' || lang ELSE section_number || '.1.2 ' || lang END"


@query(rf"""WITH {SPEC}, t AS (SELECT spec_id, doc_id, {_MIXED} AS b FROM spec), p AS (SELECT doc_id, b, lag(b) OVER (PARTITION BY spec_id ORDER BY doc_id) AS a FROM t),
n AS (SELECT *, list_filter(string_split(regexp_extract(a, '^(?:[A-Z]\.)?([0-9.]*)', 1), '.'), lambda x: x <> '') AS x, list_filter(string_split(regexp_extract(b, '^(?:[A-Z]\.)?([0-9.]*)', 1), '.'), lambda x: x <> '') AS y FROM p WHERE a IS NOT NULL)
SELECT doc_id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN a <> b WHEN len(x) <> len(y) THEN true ELSE x[1:3] <> y[1:3] END AS major FROM n""")
def q_section_change(s, d):
    n, lang = F.col("section_number"), F.col("lang")
    own = F.when(F.col("doc_id") % 5 == 0, "Introduction").when(F.col("doc_id") % 5 == 1, F.concat(n, F.lit("."), 1 + F.col("doc_id") % 3, F.lit(" "), lang)).when(F.col("doc_id") % 5 == 2, F.concat(F.lit("B."), F.expr("doc_id div 10"), F.lit(" "), lang))
    own = own.when(F.col("doc_id") % 5 == 3, F.concat(n, F.lit(".1.1 "), lang)).otherwise(F.concat(n, F.lit(".1.2 "), lang))
    rows = derived.spec(s, d).select("doc_id", own.alias("b"), F.lag(own).over(Window.partitionBy("spec_id").orderBy("doc_id")).alias("a"))
    return rows.where("a is not null").select("doc_id", T.major_change("a", "b").alias("major"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 2000 THEN left(text, 1000) || chr(10) || chr(10) || '[... content truncated ...]' || chr(10) || chr(10) || right(text, 1000) ELSE text END) AS for_correction, md5(CASE WHEN length(text) > 2500 THEN left(text, 2500) || chr(10) || chr(10) || '[... content truncated ...]' ELSE text END) AS for_validation FROM documents")
def q_truncations(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.head_and_tail("text")).alias("for_correction"), F.md5(T.head("text")).alias("for_validation"))


@query(f"""WITH {SPEC}, g AS (SELECT spec_id, doc_id // 20 AS g, count(*) AS n, count(DISTINCT split_part(section_number, '.', 1)) AS d1, count(DISTINCT split_part(section_number, '.', 2)) AS d2, count(DISTINCT split_part(section_number, '.', 3)) AS d3, min(section_number) AS m FROM spec GROUP BY ALL)
SELECT spec_id, g AS block, CASE WHEN d1 > 1 THEN '' WHEN d2 > 1 THEN split_part(m, '.', 1) WHEN d3 > 1 THEN split_part(m, '.', 1) || '.' || split_part(m, '.', 2) ELSE m END || CASE WHEN n > 1 THEN ' (Multiple subsections)' ELSE '' END AS title FROM g""")
def q_common_parent(s, d):
    own = derived.spec(s, d).groupBy("spec_id", F.expr("doc_id div 20").alias("block")).agg(F.collect_list(T.section_numbers("section_number")).alias("a"))
    return own.select("spec_id", "block", T.compound_title(T.common_parent("a"), F.size("a")).alias("title"))


# --- elements and packing


@query(r"""WITH b AS (SELECT page_id, regexp_replace(html, '(?s)<(script|style)\b.*?</(script|style)>', '', 'g') AS h FROM pages),
em AS (SELECT page_id, unnest(regexp_extract_all(h, 'ELEMENT_TAGS')) AS m, unnest(range(len(regexp_extract_all(h, 'ELEMENT_TAGS')))) AS elem_idx FROM b),
e AS (SELECT page_id, regexp_extract(m, '^<(\w+)', 1) AS tag, regexp_replace(regexp_replace(m, '^<[^>]*>', ''), '</\w+>$', '') AS body, elem_idx FROM em),
t AS (SELECT page_id, elem_idx, CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'li' THEN 'list_item' WHEN tag = 'figcaption' THEN 'figure_caption' ELSE 'text' END AS type, trim(regexp_replace(regexp_replace(body, '<[^>]*>', '', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text FROM e)
SELECT page_id, elem_idx, type, text, CAST(CASE WHEN length(text) < 30 THEN 1 WHEN length(text) < 60 THEN 2 ELSE 3 END AS BIGINT) AS level, last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY elem_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section_title FROM t WHERE text <> ''""".replace("ELEMENT_TAGS", _TAGGED))
def q_elements(s, d):
    e = tables.html_elements(table(s, d, "pages"))
    w = Window.partitionBy("page_id").orderBy("elem_idx").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(F.col("type") == "heading", F.col("text")), ignorenulls=True).over(w)
    return e.withColumn("level", T.level_by_length("text")).withColumn("section_title", carried)


_PARAS = "CASE WHEN doc_id % 2 = 0 THEN replace(text, '. ', '.' || chr(10) || chr(10)) ELSE text END"


@query(rf"""WITH RECURSIVE doc AS (SELECT doc_id, {_PARAS} AS text FROM documents WHERE text IS NOT NULL), src AS (SELECT *, length(text) // 4 > 200 AS long FROM doc),
para AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM src WHERE long),
bits AS (SELECT doc_id, i, CASE WHEN length(p) // 4 > 200 THEN string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE [p] END AS b FROM para),
parts AS (SELECT doc_id, flatten(list(b ORDER BY i)) AS p FROM bits GROUP BY doc_id),
st AS (SELECT doc_id, 1 AS i, CAST([] AS VARCHAR[]) AS done, p[1] AS cur, length(p[1]) // 4 AS n FROM parts
  UNION ALL SELECT st.doc_id, i + 1, CASE WHEN n + length(p[i + 1]) // 4 <= 200 THEN done ELSE list_append(done, cur) END,
    CASE WHEN n + length(p[i + 1]) // 4 <= 200 THEN cur || chr(10) || chr(10) || p[i + 1] WHEN cur = '' THEN p[i + 1] ELSE right(cur, 80) || chr(10) || chr(10) || p[i + 1] END,
    CASE WHEN n + length(p[i + 1]) // 4 <= 200 THEN n + length(p[i + 1]) // 4 ELSE length(right(cur, 80)) // 4 + length(p[i + 1]) // 4 END FROM st JOIN parts USING (doc_id) WHERE i < len(p)),
fin AS (SELECT doc_id, list_append(done, cur) AS c FROM st JOIN parts USING (doc_id) WHERE i = len(p) UNION ALL SELECT doc_id, [text] FROM src WHERE NOT long)
SELECT doc_id, CAST(unnest(range(len(c))) AS BIGINT) AS chunk_index, CAST(len(c) AS BIGINT) AS total_chunks, md5(unnest(c)) AS text_md5 FROM fin""")
def q_pack_truncate(s, d):
    """Every second text has a paragraph for each sentence, so that both ways of cutting are met."""
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(". "), F.lit(".\n\n"))).otherwise(F.col("text"))
    return chunking.split_long(_docs(s, d).select("doc_id", text.alias("text")), 200, 20).select("doc_id", "chunk_index", "total_chunks", F.md5("text").alias("text_md5"))


_ELEMENTS = rf"""hb AS (SELECT page_id, regexp_replace(html, '(?s)<(script|style)\b.*?</(script|style)>', '', 'g') AS h FROM pages),
hm AS (SELECT page_id, unnest(regexp_extract_all(h, '{_TAGGED}')) AS m, unnest(range(len(regexp_extract_all(h, '{_TAGGED}')))) AS elem_idx FROM hb),
he AS (SELECT page_id, regexp_extract(m, '^<(\w+)', 1) AS tag, regexp_replace(regexp_replace(m, '^<[^>]*>', ''), '</\w+>$', '') AS body, elem_idx FROM hm),
ht AS (SELECT page_id, elem_idx, tag, trim(regexp_replace(regexp_replace(body, '<[^>]*>', '', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text FROM he),
el AS (SELECT page_id AS doc_id, row_number() OVER (PARTITION BY page_id ORDER BY elem_idx) AS i, text, length(text) // 4 AS n, CASE WHEN length(text) % 5 = 0 THEN 'table' ELSE 'text' END AS type, [1 + elem_idx // 3] AS pages,
  CASE WHEN elem_idx < 2 THEN NULL WHEN (elem_idx // 4) % 4 = 3 THEN 'Overview' ELSE '6.' || (1 + (elem_idx // 4) % 3) || CASE WHEN page_id % 2 = 0 THEN '.1.' || elem_idx % 3 ELSE '' END || ' Part' END AS title FROM ht WHERE text <> '')"""


def _packed_sql(by_section: bool, hybrid: bool) -> str:
    """The packing rule as a recursion over elements: ``s`` and ``m`` are the first elements that the open chunk holds and is credited with."""
    num = lambda t: f"string_split(regexp_extract({t}, '^[0-9.]+'), '.')"
    major = f"CASE WHEN st.sec IS NULL OR title IS NULL THEN false WHEN {num('st.sec')} = [''] OR {num('title')} = [''] THEN st.sec <> title ELSE len({num('st.sec')}) <> len({num('title')}) OR {num('st.sec')}[1:3] <> {num('title')}[1:3] END"
    break_ = f"(open AND tok >= 40 AND {major})" if by_section else "false"
    full = "(tok2 + n > 240 OR tok2 + n > 120 AND tok2 >= 40)" if by_section else "tok2 + n > 120"
    body = "array_to_string(list(text ORDER BY i), chr(10) || chr(10))"
    heads = r"regexp_extract_all(array_to_string(list(text ORDER BY i), ' '), '(?m)^\s*(\d+(?:\.\d+)*)\s+[A-Z][^\n]*', 1)"
    name = "max_by(title, i) FILTER (WHERE i >= m AND title IS NOT NULL)"
    if hybrid:
        # front: as many leading parts as all of the headings' numbers share
        front = f"list_reduce(list_transform({heads}, lambda x: string_split(x, '.')), lambda a, b: list_filter(a, lambda x, k: a[:k] = b[:k] AND len(b) >= k))"
        name = f"CASE WHEN len({heads}) > 1 AND len({front}) > 0 THEN array_to_string({front}, '.') || ' (Multiple subsections)' ELSE {name} END"
        name = f"CASE WHEN any_value(big) THEN max_by(title, i) FILTER (WHERE i >= m AND title IS NOT NULL) ELSE {name} END"
    return rf"""WITH RECURSIVE {_ELEMENTS}, doc AS (SELECT doc_id, list(n ORDER BY i) AS ns, list(text ORDER BY i) AS ts, count(*) AS last FROM el GROUP BY doc_id),
st AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS s, CAST(1 AS BIGINT) AS m, CAST(0 AS BIGINT) AS tok, CAST(NULL AS VARCHAR) AS sec, CAST([] AS STRUCT(a BIGINT, b BIGINT, m BIGINT, big BOOLEAN)[]) AS done FROM doc
  UNION ALL SELECT z.doc_id, z.i, CASE WHEN big THEN z.i + 1 WHEN full_ THEN s3 ELSE s2 END, CASE WHEN big THEN z.i + 1 WHEN full_ OR brk THEN z.i ELSE z.m END,
    CASE WHEN big THEN 0 WHEN full_ THEN length(array_to_string(ts[s3:z.i - 1], ' ')) // 4 + n ELSE tok2 + n END, CASE WHEN big THEN title ELSE coalesce(title, sec) END,
    list_concat(z.done, list_concat(CASE WHEN (big OR brk OR full_) AND z.s < z.i THEN [{{a: z.s, b: z.i - 1, m: z.m, big: false}}] ELSE [] END, CASE WHEN big THEN [{{a: z.i, b: z.i, m: z.i, big: true}}] ELSE [] END))
  FROM (SELECT y.*, NOT big AND {full} AND s2 < y.i AS full_, CASE WHEN tok2 <= 20 THEN y.i ELSE coalesce(list_min(list_filter(range(s2, y.i), lambda k: list_sum(ns[k:y.i - 1]) <= 20)), y.i) END AS s3
    FROM (SELECT x.*, NOT big AND {break_.replace('open', 'x.s < x.i').replace('st.sec', 'x.sec')} AS brk, CASE WHEN NOT big AND {break_.replace('open', 'x.s < x.i').replace('st.sec', 'x.sec')} THEN 0 ELSE tok END AS tok2, CASE WHEN NOT big AND {break_.replace('open', 'x.s < x.i').replace('st.sec', 'x.sec')} THEN x.i ELSE x.s END AS s2
      FROM (SELECT st.doc_id, el.i, st.s, st.m, st.tok, st.sec, st.done, el.n, el.title, doc.ns, doc.ts, el.type = 'table' AND el.n > 120 AS big FROM st JOIN el ON el.doc_id = st.doc_id AND el.i = st.i + 1 JOIN doc ON doc.doc_id = st.doc_id) x) y) z),
fin AS (SELECT st.doc_id, list_concat(done, CASE WHEN s <= last THEN [{{a: s, b: last, m: m, big: false}}] ELSE [] END) AS c FROM st JOIN doc ON doc.doc_id = st.doc_id AND st.i = last),
ch AS (SELECT doc_id, unnest(range(len(c))) AS chunk_index, unnest(c) AS k FROM fin), own AS (SELECT ch.doc_id, chunk_index, k.m AS m, k.big AS big, el.* EXCLUDE (doc_id) FROM ch JOIN el ON el.doc_id = ch.doc_id AND el.i BETWEEN k.a AND k.b)
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, md5({body}) AS text_md5, CAST(length({body}) // 4 AS BIGINT) AS n_tokens, array_to_string(list_sort(list_distinct(flatten(list(pages) FILTER (WHERE i >= m)))), ',') AS page_numbers,
  CASE WHEN any_value(big) THEN 'table' ELSE 'text' END AS chunk_type, {name} AS section_title FROM own GROUP BY doc_id, chunk_index, m"""


def _elements(s, d):
    """Elements of the pages with made-up tables, pages and numbered titles, so that every rule of the packers is met."""
    e, k = tables.html_elements(table(s, d, "pages")), F.col("elem_idx")
    part = F.concat(F.lit("6."), 1 + F.expr("elem_idx div 4") % 3, F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(".1."), k % 3)).otherwise(""), F.lit(" Part"))
    title = F.when(k < 2, F.lit(None)).when(F.expr("elem_idx div 4") % 4 == 3, "Overview").otherwise(part)
    kind = F.when(F.length("text") % 5 == 0, "table").otherwise("text")
    return e.select(F.col("page_id").alias("doc_id"), "elem_idx", "text", kind.alias("type"), F.array(F.expr("int(1 + elem_idx div 3)")).alias("page_numbers"), title.alias("section_title"), title.alias("section_path"))


def _packed(s, d, strategy, **sizes):
    out = chunking.create_chunker(strategy, size=120, overlap=20, **sizes)(_elements(s, d))
    return out.select("doc_id", "chunk_index", F.md5("text").alias("text_md5"), "n_tokens", F.array_join("page_numbers", ",").alias("page_numbers"), "chunk_type", "section_title")


@query(_packed_sql(False, False))
def q_pack_semantic(s, d):
    return _packed(s, d, "semantic")


@query(_packed_sql(True, False))
def q_pack_section_aware(s, d):
    return _packed(s, d, "section_aware", minimum=40, maximum=240)


@query(_packed_sql(True, True))
def q_pack_hybrid(s, d):
    return _packed(s, d, "hybrid", minimum=40, maximum=240)


@query(rf"""WITH RECURSIVE {_ELEMENTS}, hd AS (SELECT doc_id, i, text, i % 4 = 1 AS heading, CASE WHEN length(text) < 30 THEN 1 WHEN length(text) < 60 THEN 2 ELSE 3 END AS level FROM el),
st AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS path, CAST([] AS VARCHAR[]) AS before, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS was FROM (SELECT DISTINCT doc_id FROM hd)
  UNION ALL SELECT hd.doc_id, hd.i, CASE WHEN NOT heading THEN path WHEN level = 1 THEN [text] WHEN len(path) >= level - 1 THEN list_append(path[1:level - 1], text) ELSE list_append(path, text) END, path, CASE WHEN heading THEN text ELSE title END, title
    FROM st JOIN hd ON hd.doc_id = st.doc_id AND hd.i = st.i + 1)
SELECT doc_id, i, was AS section_title, nullif(array_to_string(before, ' > '), '') AS section_path FROM st WHERE i > 0""")
def q_heading_stack(s, d):
    """Every fourth element is made a heading."""
    e = _elements(s, d).select("doc_id", "elem_idx", "text")
    e = e.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("elem_idx")).cast("long"))
    return tables.with_sections(e.withColumn("type", F.when(F.col("i") % 4 == 1, "heading").otherwise("text")), spread=True).select("doc_id", "i", "section_title", "section_path")


# --- quality and evaluation


@query("SELECT count(*) AS validated, count(*) FILTER (WHERE quality = 1) AS matches, count(*) FILTER (WHERE quality = 0) AS mismatches, count(*) FILTER (WHERE toxic = 1) AS low_relevance, count(*) FILTER (WHERE quality IS NULL) AS errors FROM labels")
def q_validation_stats(s, d):
    q = F.col("quality")
    return table(s, d, "labels").agg(F.count("*").alias("validated"), F.count_if(q == 1).alias("matches"), F.count_if(q == 0).alias("mismatches"), F.count_if(F.col("toxic") == 1).alias("low_relevance"), F.count_if(q.isNull()).alias("errors"))


@query("""WITH r AS (SELECT source, quality = 1 AS ok, CASE WHEN toxic = 1 THEN 0.4::DOUBLE ELSE 0.9::DOUBLE END AS rel FROM labels JOIN documents USING (doc_id)), g AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE ok) AS matches, round(avg(rel), 6) AS mean_relevance, count(*) FILTER (WHERE rel < 0.7 OR NOT coalesce(ok, false)) AS needs_review FROM r GROUP BY source)
SELECT *, CASE WHEN matches / n >= 0.9 THEN 'A' WHEN matches / n >= 0.8 THEN 'B' WHEN matches / n >= 0.7 THEN 'C' ELSE 'D-F' END AS grade FROM g""")
def q_quality_report(s, d):
    rows = table(s, d, "labels").join(_docs(s, d).select("doc_id", "source"), "doc_id").select("source", (F.col("quality") == 1).alias("ok"), F.when(F.col("toxic") == 1, 0.4).otherwise(0.9).alias("rel"))
    g = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if("ok").alias("matches"), F.round(F.avg("rel"), 6).alias("mean_relevance"), F.count_if((F.col("rel") < 0.7) | ~F.coalesce("ok", F.lit(False))).alias("needs_review"))
    return g.withColumn("grade", T.grade(F.try_divide("matches", "n")))


_EVAL = rf"""{_BM25}, t AS (SELECT k.query_id, k.doc_id, b.text AS q, d.text, d.source, b.item_id % 5 AS category FROM kr k JOIN benchmark b ON b.item_id = k.query_id JOIN documents d USING (doc_id) WHERE rank = 1),
p AS (SELECT *, len(list_filter(string_split_regex(lower(q), '\s+'), lambda w: length(w) > 3 AND contains(lower(text), w))) AS kw FROM t),
sc5 AS (SELECT category, CASE WHEN source = 'src' || category THEN 5 ELSE 2 END AS a, CASE WHEN abs(doc_id % 40 - query_id) = 0 THEN 5 WHEN abs(doc_id % 40 - query_id) <= 2 THEN 4 ELSE 2 END AS c, CASE WHEN kw >= 3 THEN 5 WHEN kw >= 2 THEN 4 ELSE 3 END AS k FROM p)"""


@query(f"WITH {_EVAL} SELECT category, count(*) AS questions, CAST(sum(a + 5 + 3 + c + k) AS BIGINT) AS points, round(100.0::DOUBLE * sum(a + 5 + 3 + c + k) / (25 * count(*)), 6) AS pct, CAST(grouping(category) AS BIGINT) AS overall FROM sc5 GROUP BY ROLLUP (category)")
def q_eval_rollup(s, d):
    hits = written(_bm25(s, d, 1).join(table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q")), "query_id"), "firsts")
    rows = _docs(s, d).join(retrieval.small(hits), "doc_id").withColumn("category", F.col("query_id") % 5)
    off, kw = F.abs(F.col("doc_id") % 40 - F.col("query_id")), T.keyword_overlap("q", "text")
    points = F.when(F.col("source") == F.concat(F.lit("src"), "category"), 5).otherwise(2) + 8 + F.when(off == 0, 5).when(off <= 2, 4).otherwise(2) + F.when(kw >= 3, 5).when(kw >= 2, 4).otherwise(3)
    total = F.sum("points")
    return rows.withColumn("points", points).rollup("category").agg(F.count("*").alias("questions"), total.alias("points"), F.round(100.0 * total / (25 * F.count("*")), 6).alias("pct"), F.grouping("category").cast("long").alias("overall"))


@query("""WITH r AS (SELECT doc_id AS chunk_id, source, round(CASE WHEN toxic = 1 THEN 0.1::DOUBLE ELSE 0.6::DOUBLE END + (doc_id % 30) / 100.0::DOUBLE, 6) AS relevance_score FROM labels JOIN documents USING (doc_id))
SELECT * FROM r WHERE relevance_score < 0.7 ORDER BY relevance_score, chunk_id LIMIT 10""")
def q_low_relevance(s, d):
    rows = table(s, d, "labels").join(_docs(s, d).select("doc_id", "source"), "doc_id")
    score = F.round(F.when(F.col("toxic") == 1, 0.1).otherwise(0.6) + F.col("doc_id") % 30 / F.lit(100.0), 6)
    return sections.low_relevance(rows.select(F.col("doc_id").alias("chunk_id"), "source", score.alias("relevance_score")))


_PATHS = "pt AS (SELECT doc_id, lang, concat_ws(' > ', source, lang) || CASE WHEN coalesce(CASE WHEN n_chars > 3000 THEN 'CSD' END, '') <> '' THEN ' - CSD' ELSE '' END AS path, length(text) AS chars FROM documents WHERE length(text) >= 50)"


@query(f"WITH {_PATHS} SELECT lang, count(*) AS chunks, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(chars // 4) AS BIGINT) AS tokens, round(avg(chars // 4), 6) AS mean_tokens, round(100.0::DOUBLE * count(*) FILTER (WHERE contains(path, ' - ')) / count(*), 6) AS with_subtitle FROM pt GROUP BY lang")
def q_stored_stats(s, d):
    path = T.path_with_subtitle(F.concat_ws(" > ", "source", "lang"), F.when(F.col("n_chars") > 3000, "CSD"))
    return store.chunk_stats(_docs(s, d).select("lang", "text", path.alias("section_path")), "lang")


_MARKED = "CASE doc_id % 6 WHEN 0 THEN ' - Table 4' WHEN 1 THEN ' - CSD' WHEN 2 THEN ' - ' || substr(text, 3, 6) WHEN 3 THEN ' Page 7' WHEN 4 THEN ' [Inferred]' ELSE '' END"


@query(rf"""WITH e AS (SELECT doc_id, concat_ws(' > ', source, lang) || {_MARKED} AS path, coalesce(source, '') AS title, text, [doc_id % 40, doc_id % 40 + 6] AS pages, CASE WHEN doc_id % 7 > 0 THEN doc_id % 50 END AS page FROM documents WHERE length(text) > 20),
g AS (SELECT *, split_part(path, ' - ', -1) AS sub, len(list_filter(string_split('the tion and that with', ' '), lambda w: length(w) > 3 AND contains(lower(text), w))) AS kw FROM e),
p AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 4 WHEN contains(path, 'src1') THEN 5 ELSE 2 END AS retrieval_accuracy, CASE WHEN contains(path, '[Inferred]') OR contains(path, 'Page ') THEN 2 ELSE 5 END AS section_path_quality,
  CASE WHEN NOT contains(path, ' - ') THEN 3 WHEN contains(sub, 'Table ') THEN 2 WHEN contains(lower(sub), 'csd') THEN 5 WHEN contains(substr(text, 1, 500), sub) THEN 4 ELSE 2 END AS subtitle_accuracy,
  CASE WHEN page IS NULL OR page = 0 THEN 4 WHEN list_contains(pages, page) THEN 5 WHEN abs(pages[1] - page) <= 2 OR abs(pages[2] - page) <= 2 THEN 4 ELSE 2 END AS citation_accuracy, CASE WHEN kw >= 3 THEN 5 WHEN kw >= 2 THEN 4 ELSE 3 END AS content_completeness FROM g),
t AS (SELECT *, 4 * (retrieval_accuracy + section_path_quality + subtitle_accuracy + citation_accuracy + content_completeness) AS pct FROM p)
SELECT doc_id, CAST(retrieval_accuracy AS BIGINT) AS retrieval_accuracy, CAST(section_path_quality AS BIGINT) AS section_path_quality, CAST(subtitle_accuracy AS BIGINT) AS subtitle_accuracy, CAST(citation_accuracy AS BIGINT) AS citation_accuracy, CAST(content_completeness AS BIGINT) AS content_completeness,
  CASE WHEN pct >= 90 THEN 'EXCELLENT' WHEN pct >= 75 THEN 'GOOD' WHEN pct >= 60 THEN 'ACCEPTABLE' ELSE 'NEEDS WORK' END AS grade FROM t""")
def q_evaluation_points(s, d):
    """Documents as top hits, with paths that show every flaw and subtitle."""
    n, docs = F.col("doc_id"), _docs(s, d).where(F.length("text") > 20)
    ends = (F.lit(" - Table 4"), F.lit(" - CSD"), F.concat(F.lit(" - "), F.substring("text", 3, 6)), F.lit(" Page 7"), F.lit(" [Inferred]"), F.lit(""))
    path = F.concat(F.concat_ws(" > ", "source", "lang"), F.element_at(F.array(*ends), (n % 6 + 1).cast("int")))
    rows = docs.select("doc_id", "text", path.alias("path"), F.coalesce("source", F.lit("")).alias("title"), F.array(n % 40, n % 40 + 6).alias("pages"), F.when(n % 7 > 0, n % 50).alias("page"), F.when(n % 11 > 0, "SRC1").alias("expected"))
    points = T.evaluation_points("path", "title", "text", "pages", F.lit("the tion and that with"), "expected", F.lit("csd"), "page")
    rows = rows.select("doc_id", points.alias("p")).select("doc_id", "p.*")
    return rows.withColumn("grade", T.evaluation_grade(4 * sum((F.col(c) for c in rows.columns[1:]), F.lit(0))))


# --- questions to answers

_ASK = rf"""{_BM25}, qt AS (SELECT item_id AS query_id, text, {_CLASS} AS query_type FROM benchmark), pl AS (SELECT * FROM qt JOIN (VALUES {_ROUTES}) r(query_type, strategy, top_k, min_score) USING (query_type)),
dw AS (SELECT doc_id, CAST(concat('0x', substr(md5(t), 1, 7)) AS BIGINT) % 64 AS k, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id, unnest({_TOK}) AS t FROM documents) GROUP BY ALL), dz AS (SELECT doc_id, sqrt(sum(n * n)) AS z FROM dw GROUP BY doc_id),
qw AS (SELECT item_id AS query_id, CAST(concat('0x', substr(md5(t), 1, 7)) AS BIGINT) % 64 AS k, CAST(count(*) AS DOUBLE) AS n FROM (SELECT item_id, unnest({_TOK}) AS t FROM benchmark) GROUP BY ALL), qz AS (SELECT query_id, sqrt(sum(n * n)) AS z FROM qw GROUP BY query_id),
vs AS (SELECT query_id, doc_id, sum(qw.n * dw.n) AS dot FROM qw JOIN dw USING (k) GROUP BY ALL), vc AS (SELECT query_id, doc_id, round(dot / (qz.z * dz.z), 6) AS score FROM vs JOIN qz USING (query_id) JOIN dz USING (doc_id)),
vk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vc),
vh AS (SELECT vk.*, strategy, top_k FROM vk JOIN pl USING (query_id) WHERE rank <= CASE WHEN strategy = 'hybrid' THEN 2 * top_k ELSE top_k END AND (min_score IS NULL OR score >= min_score)),
fl AS (SELECT query_id, doc_id, max(v) AS v, max(w) AS w FROM (SELECT query_id, doc_id, rank AS v, NULL AS w FROM vh WHERE strategy = 'hybrid' UNION ALL SELECT query_id, doc_id, NULL, rank FROM kr JOIN pl USING (query_id) WHERE strategy = 'hybrid' AND rank <= 2 * top_k) GROUP BY ALL),
fs AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + v), 0) + coalesce(1.0::DOUBLE / (60 + w), 0), 9) AS score FROM fl), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, v NULLS LAST, w NULLS LAST) AS rank FROM fs),
hh AS (SELECT query_id, doc_id, score, rank FROM vh WHERE strategy <> 'hybrid' UNION ALL SELECT query_id, doc_id, score, rank FROM fr JOIN pl USING (query_id) WHERE rank <= top_k),
h1 AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS rank, coalesce(d.text, '') AS text, concat_ws(' > ', source, lang) AS section_path FROM hh JOIN documents d USING (doc_id)),
h2 AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS m, count(*) OVER (PARTITION BY query_id, coalesce(nullif(section_path, ''), 'unknown')) AS c FROM h1),
h3 AS (SELECT *, round(score * (1 + CAST(0.15 AS DOUBLE) * (c - 1)) + CAST(1e-9 AS DOUBLE), 6) AS boosted FROM h2),
hit AS (SELECT query_id, doc_id, CASE WHEN m > 1 THEN boosted ELSE score END AS score, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, rank) AS rank, text, section_path, m FROM h3)"""
_SAID = rf"""{_ASK}, an AS (SELECT query_id, string_agg(trim(substr(text, 1, 160)) || ' [' || rank || ']', ' ' ORDER BY rank) AS answer FROM hit WHERE rank <= 3 GROUP BY query_id), tp AS (SELECT query_id, score AS top, m FROM hit WHERE rank = 1),
sd AS (SELECT pl.query_id, query_type, strategy, coalesce(answer, 'I cannot answer this based on the provided context') AS answer, top, coalesce(m, 0) AS m FROM pl LEFT JOIN an USING (query_id) LEFT JOIN tp USING (query_id)),
ct AS (SELECT query_id, list_distinct(list_filter(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: CAST(x AS BIGINT)), lambda x: x BETWEEN 1 AND m)) AS cited FROM sd),
cf AS (SELECT query_id, CASE WHEN top IS NULL THEN 0 WHEN contains(lower(answer), 'i cannot answer') OR contains(lower(answer), 'not found in the context') OR contains(lower(answer), 'insufficient information') OR contains(lower(answer), 'context doesn''t contain') OR contains(lower(answer), 'unable to determine') THEN greatest(0.3::DOUBLE, top * 0.5::DOUBLE)
  WHEN NOT regexp_matches(answer, '\[\d+\]') THEN greatest(0.4::DOUBLE, top * 0.6::DOUBLE) ELSE least(1.0::DOUBLE, top * 1.1::DOUBLE) END AS confidence FROM sd)"""


def _questions(s, d):
    """Planned questions, hits by hashed vectors, and the chunks: documents, asked by the benchmark's items. Hits are written once, however often they are read."""
    docs = _docs(s, d)
    planned = answers.plan(_asked(s, d))
    base = written(docs.select("doc_id", retrieval.hashed_vector("text").alias("embedding")), "hashed")
    vector = written(retrieval.vector_topk(base, planned.select("query_id", retrieval.hashed_vector("text").alias("embedding")), 30, "doc_id"), "near")
    chunks = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.concat_ws(" > ", "source", "lang").alias("section_path"), F.array(F.col("doc_id") % 97).alias("pages"), "source")
    return planned, vector, chunks


def _retrieved(s, d):
    """Planned questions and their hits, by vectors and words."""
    planned, vector, chunks = _questions(s, d)
    return planned, answers.retrieve(planned, vector, written(_bm25(s, d, 30), "worded"), chunks)


@query(f"WITH {_ASK} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM hit")
def q_retrieve(s, d):
    return _retrieved(s, d)[1].select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_SAID}, cx AS (SELECT *, length('[' || rank || '] ' || section_path || ' (Page ' || (doc_id % 97) || ', Relevance: ' || printf('%.1f%%', score * 100) || ')') AS head FROM hit WHERE rank <= 5),
rm AS (SELECT *, 4000 - coalesce(sum(head + length(text) + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM cx),
ln AS (SELECT query_id, sum(head + 2 + CASE WHEN length(text) > room THEN room + 3 ELSE length(text) END) + 6 * (count(*) - 1) AS chars FROM rm WHERE room > 0 GROUP BY query_id)
SELECT query_id, query_type, strategy, md5(answer) AS answer_md5, m AS num_chunks, CAST(len(cited) AS BIGINT) AS num_citations, array_to_string(list_sort(cited), ',') AS cited, round(confidence, 6) AS confidence, round(coalesce(top, 0), 6) AS top_score, CAST(coalesce(chars, 26) AS BIGINT) AS context_chars
FROM sd JOIN ct USING (query_id) JOIN cf USING (query_id) LEFT JOIN ln USING (query_id)""")
def q_answer_batch(s, d):
    out = answers.answer(*_retrieved(s, d))
    return out.select(
        "query_id", "query_type", "strategy", F.md5("answer").alias("answer_md5"), "num_chunks", "num_citations", F.array_join(F.array_sort(F.transform("citations", lambda c: c["number"])), ",").alias("cited"),
        F.round("confidence", 6).alias("confidence"), F.round("top_score", 6).alias("top_score"), F.length("context").cast("long").alias("context_chars"),
    )


@query(f"""WITH {_SAID}, ci AS (SELECT query_id, count(*) AS n FROM hit JOIN ct USING (query_id) WHERE list_contains(cited, rank) GROUP BY query_id)
SELECT query_id, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS bucket, coalesce(n, 0) AS sources, starts_with(answer, 'I cannot') AS refused FROM sd JOIN cf USING (query_id) LEFT JOIN ci USING (query_id)""")
def q_answer_format(s, d):
    out = answers.answer(*_retrieved(s, d))
    shown = answers.formatted(out).withColumn("bucket", F.lower(F.regexp_extract("shown", r"\*\*Confidence:\*\* \S+ (High|Medium|Low) Confidence \(", 1)))
    shown = shown.withColumn("sources", F.regexp_count(F.substring_index("shown", "## 📚 Sources", -1), F.lit(r"(?m)^📄 Page \S+ · Relevance: [0-9.]+%$")).cast("long"))
    return shown.select("query_id", "bucket", "sources", F.startswith("shown", F.lit("I cannot")).alias("refused"))


@query(f"""WITH {_ASK}, sm AS (SELECT vk.query_id, rank, score, coalesce(text, '') AS text, source FROM vk JOIN documents USING (doc_id) WHERE rank <= 10 AND score >= 0.3),
ag AS (SELECT query_id, max(score) AS confidence, max_by(text, -rank) AS text, max_by(coalesce(source, 'N/A'), -rank) AS title, least(count(*), 5) AS n, md5(string_agg(substr(text, 1, 300) || '...', '' ORDER BY rank) FILTER (WHERE rank <= 5)) AS cited_md5 FROM sm GROUP BY query_id)
SELECT query_id, CASE WHEN ag.query_id IS NULL THEN 'I couldn''t find any relevant information.' ELSE '**Relevant Information:**' || chr(10) || chr(10) || substr(ag.text, 1, 800) || '...' END AS opening, coalesce(title, '') AS title, coalesce(confidence, 0) AS confidence, coalesce(n, 0) AS n, coalesce(cited_md5, md5('')) AS cited_md5 FROM pl LEFT JOIN ag USING (query_id)""")
def q_simple_mode(s, d):
    planned, vector, chunks = _questions(s, d)
    hits = chunks.select("doc_id", "text", "pages", "source", F.col("source").alias("section_title")).join(retrieval.small(vector.where("rank <= 10 AND score >= 0.3D")), "doc_id")
    out = answers.simple(planned, hits)
    opening = F.split("answer", r"\n\n\*This is a simple")[0]
    return out.select(
        "query_id", F.when(F.col("answer") == answers.NO_RESULT, F.substring_index("answer", " Please", 1)).otherwise(opening).alias("opening"), F.regexp_extract("answer", r"\*\*Top Match:\*\* (.*) \(Confidence: [0-9.]+%\)", 1).alias("title"), "confidence",
        F.size("citations").cast("long").alias("n"), F.md5(F.array_join(F.transform("citations", lambda c: c["text"]), "")).alias("cited_md5"),
    )


_CHUNK_TITLES = "ch AS (SELECT doc_id, lang, text, CASE doc_id % 3 WHEN 0 THEN 'Figure 1' WHEN 1 THEN source || ' ' || lang END AS title, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')[1] AS l FROM documents), cl AS (SELECT *, nullif(trim(substr(trim(l), 1, 60)), '') AS line FROM ch)"


def _chunk_titles(s, d):
    title = F.when(F.col("doc_id") % 3 == 0, "Figure 1").when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit(" "), "lang"))
    return _docs(s, d).select(F.col("doc_id").alias("chunk_id"), "lang", "text", title.alias("section_title"), F.lit(None).cast("string").alias("section_path"))


@query(f"WITH {_CHUNK_TITLES} SELECT lang, count(*) AS total, count(*) FILTER (WHERE doc_id % 3 <> 1 OR title IS NULL) AS corrected, count(*) FILTER (WHERE doc_id % 3 = 1 AND title IS NOT NULL) AS skipped, CAST(0 AS BIGINT) AS failed FROM cl GROUP BY lang")
def q_correction_batch(s, d):
    return sections.correction_stats(sections.correct(_chunk_titles(s, d)), "lang")


@query(rf"""WITH {_CHUNK_TITLES}, co AS (SELECT doc_id AS chunk_id, text, line, coalesce(line, title) AS title, CASE WHEN line IS NULL THEN 0.0::DOUBLE ELSE 0.8::DOUBLE END AS sure FROM cl),
tk AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(coalesce(title, '')), '\s+'), lambda x: x <> '')) AS tw, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS bw FROM co),
sh AS (SELECT *, coalesce(CAST(len(list_filter(tw, lambda x: list_contains(bw, x))) AS DOUBLE) / nullif(len(tw), 0), 0) AS share FROM tk), nr AS (SELECT *, round(share, 6) < 0.7 OR share < 0.5 AS review FROM sh)
SELECT chunk_id, CASE WHEN review AND share < 0.5 AND line IS NOT NULL THEN line ELSE title END AS section_title, sure AS correction_confidence, share >= 0.5 AS is_match, round(share, 6) AS relevance_score, review AS needs_review, review AND share < 0.5 AND line IS NOT NULL AS auto_fixed, review AND NOT (share < 0.5 AND line IS NOT NULL) AS needs_manual_review FROM nr""")
def q_quality_assurance(s, d):
    return sections.assure(_chunk_titles(s, d)).select("chunk_id", "section_title", "correction_confidence", "is_match", "relevance_score", "needs_review", "auto_fixed", "needs_manual_review")


_QUOTE = "replace(section_number, '.', '\\.')"


@query(rf"""WITH {_RNG}, ct AS (SELECT r.spec_id, r.section_number, r.section_title || CASE WHEN any_value(sp.doc_id) % 5 = 1 THEN ' [7]' ELSE '' END AS section_title, r.level, r.inferred, r.page_start, r.page_end, string_agg(p.text, chr(10) || chr(10) ORDER BY p.page_no) AS raw FROM rng r JOIN page p ON p.spec_id = r.spec_id AND p.page_no BETWEEN r.page_start AND r.page_end LEFT JOIN spec sp ON sp.spec_id = r.spec_id AND sp.section_number = r.section_number GROUP BY r.spec_id, r.section_number, r.section_title, r.level, r.inferred, r.page_start, r.page_end),
sb AS (SELECT *, coalesce(nullif(trim(regexp_extract(substr(raw, 1, 500), '{T.QUOTED_SUBTITLE}', 1)), ''), nullif(regexp_extract(substr(raw, 1, 500), '{T.CODE_SUBTITLE}', 1), ''), list_filter(list_transform(string_split(substr(raw, 1, 500), chr(10))[1:10], lambda x: trim(x)), lambda x: length(x) >= 5 AND length(x) <= 50 AND regexp_matches(x, '^\p{{Lu}}') AND NOT starts_with(x, section_number) AND (NOT ends_with(x, '.') OR len(regexp_extract_all(x, ' ')) <= 5) AND NOT regexp_matches(x, '(?i)JEDEC Standard No\.|Page \d+|^\d+\s*$|Copyright|All rights reserved|^Table \d+|^Figure \d+|^\d+\.\d+'))[1]) AS subtitle FROM ct),
tl AS (SELECT * EXCLUDE (section_title), CASE WHEN inferred THEN coalesce(nullif(regexp_extract(substr(raw, 1, 2000), '(?m)' || {_QUOTE} || '\s+([A-Z][^
]{{2,80}}?)(?:
|$|\.\.\.)', 1), ''), section_title) ELSE section_title END AS section_title FROM sb),
px AS (SELECT spec_id, section_number, unnest(range(1, len(string_split(section_number, '.')) + 1)) AS i FROM tl), pt AS (SELECT *, array_to_string(string_split(section_number, '.')[1:i], '.') AS prefix FROM px),
pa AS (SELECT pt.spec_id, pt.section_number, string_agg(prefix || coalesce(' ' || tl.section_title, ''), ' → ' ORDER BY i) AS path FROM pt LEFT JOIN tl ON tl.spec_id = pt.spec_id AND tl.section_number = pt.prefix GROUP BY ALL)
SELECT spec_id AS doc_id, sha256(concat_ws(':', spec_id, section_number, page_start, 0)) AS chunk_id, section_title, path || CASE WHEN coalesce(subtitle, '') <> '' THEN ' - ' || subtitle ELSE '' END AS section_path, CAST(page_start AS VARCHAR) AS pages, page_end, 'text' AS chunk_type FROM tl JOIN pa USING (spec_id, section_number)""")
def q_toc_chunks(s, d):
    """The whole way from pages to stored chunks: the book's table of contents comes first, its pages follow behind it. The first pattern that fits an
    entry leaves the reference mark of some titles."""
    front = 25
    body = derived.pages(s, d).withColumn("page_no", F.col("page_no") + front)
    pages = derived.toc(s, d).select("spec_id", F.col("page_no").cast("long").alias("page_no"), "text").unionByName(body)
    out = toc.stored_chunks(toc.chunk_document(pages, front))
    return out.select("doc_id", "chunk_id", "section_title", "section_path", F.array_join("page_numbers", ",").alias("pages"), "page_end", "chunk_type")


# --- store


@query("""WITH new AS (SELECT doc_id, 'new' AS source, n_chars + turn AS n_chars FROM documents JOIN conversations ON conv_id = doc_id QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY turn DESC) = 1)
SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new""")
def q_upsert_latest(s, d):
    """Each turn of the conversation of a document's number is a new version of the document."""
    docs = _docs(s, d).select("doc_id", "source", "n_chars")
    new = docs.join(table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn"), "doc_id")
    return store.upsert(docs, new.select("doc_id", F.lit("new").alias("source"), (F.col("n_chars") + F.col("turn")).alias("n_chars"), F.col("turn").alias("seq")), "doc_id")


@query("SELECT doc_id, source, coalesce(toxic, 0) <> 1 AS is_active FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)")
def q_soft_delete(s, d):
    registry = _docs(s, d).select("doc_id", "source", F.lit(True).alias("is_active"))
    return store.soft_delete(registry, table(s, d, "labels").where("toxic = 1"))


@query("SELECT d.doc_id AS chunk_id, CASE WHEN l.doc_id IS NOT NULL AND l.quality = 0 THEN 'fixed ' || lang ELSE source END AS section_title FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)")
def q_payload_update(s, d):
    docs = _docs(s, d)
    marks = table(s, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"))
    changes = docs.join(marks, "doc_id").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("fixed "), "lang").alias("section_title"), F.when(F.col("q") == 0, 0.9).alias("correction_confidence"))
    return store.update_payload(docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("section_title")), changes, "section_title")


@query("SELECT event_id AS query_id, ts, event_type, value FROM events ORDER BY ts DESC, event_id LIMIT 100")
def q_audit_history(s, d):
    return store.history(table(s, d, "events").select(F.col("event_id").alias("query_id"), "ts", "event_type", "value"), 100)


@query("SELECT event_type AS model, count(*) AS n, round(avg(value), 6) AS mean_latency, max(value) AS max_latency FROM events GROUP BY event_type")
def q_pipeline_stats(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_latency"), F.max("value").alias("max_latency"))


@query("SELECT lang AS protocol, count(*) AS documents, count(DISTINCT source) AS versions, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) GROUP BY lang")
def q_registry_summary(s, d):
    active = _docs(s, d).join(table(s, d, "labels").where("toxic = 1"), "doc_id", "left_anti")
    return active.groupBy(F.col("lang").alias("protocol")).agg(F.count("*").alias("documents"), F.countDistinct("source").alias("versions"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, source FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 2) AND source = 'src3'")
def q_protocol_filter(s, d):
    docs = _docs(s, d)
    top = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(2)
    return docs.where("source = 'src3'").join(top, "lang", "left_semi").select("doc_id", "source")


@query("SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS k FROM documents ORDER BY k, doc_id LIMIT 20")
def q_sample(s, d):
    return _docs(s, d).select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("k")).orderBy("k", "doc_id").limit(20)


@query("SELECT doc_id, rpad(coalesce(lang, ''), 15, ' ') || ' ' || rpad(coalesce(source, ''), 10, ' ') || ' ' || rpad(substr(md5(text), 1, 28), 30, ' ') || ' ' || rpad(CAST(n_chars AS VARCHAR), 8, ' ') || ' ' || rpad('', 8, ' ') || ' ' || rpad('2024-01-01 00:00:00', 20, ' ') AS line FROM documents WHERE text IS NOT NULL")
def q_document_table(s, d):
    docs = _docs(s, d).where("text is not null")
    return store.document_table(docs.select("doc_id", F.col("lang").alias("protocol"), F.col("source").alias("version"), F.md5("text").alias("title"), F.col("n_chars").alias("total_pages"), F.lit(None).alias("total_chunks"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("uploaded_at")))


@query("SELECT e.event_id, e.user_id AS chunk_id, d.source, d.n_chars FROM events e JOIN documents d ON d.doc_id = e.user_id")
def q_ordered_lookup(s, d):
    """Lists of ids to their chunks, each with its place in the list; ids that are not there drop out."""
    ids = table(s, d, "events").select(F.col("user_id").alias("chunk_id"), "event_id")
    return store.by_ids(_docs(s, d).select(F.col("doc_id").alias("chunk_id"), "source", "n_chars"), ids)


@query("SELECT doc_id, source, lang FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def q_first_n(s, d):
    return store.first_n(_docs(s, d).withColumn("least", -F.col("n_chars")), 20, "least", "doc_id").select("doc_id", "source", "lang")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, [1 + event_id % 3, 2][1:CAST(event_id % 3 AS INTEGER)] = [] AS unpaged, '{\"k\":' || (event_id % 5) || '}' AS json FROM events WHERE ts IS NOT NULL")
def q_encodings(s, d):
    e = table(s, d, "events").where("ts is not null")
    pages = F.slice(F.array((1 + F.col("event_id") % 3).cast("int"), F.lit(2)), 1, (F.col("event_id") % 3).cast("int"))
    paged = T.default_pages(pages)
    iso = T.iso_time(F.date_trunc("second", "ts"))
    back = F.date_format(T.from_iso_time(iso), "yyyy-MM-dd'T'HH:mm:ss")
    return e.select("event_id", F.when(back == iso, iso).alias("iso"), ((F.size(pages) == 0) & (paged == F.array(F.lit(1)))).alias("unpaged"), F.to_json(F.struct((F.col("event_id") % 5).alias("k"))).alias("json"))


def entry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited context of vector hits: top-k, documents, context within its budget."""
    return q_context_assembly(spark, sf_dir)
