"""Text, section-number and citation functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line and title patterns of the documents' layout.
DOT_LEADER = r"\.{3,}\s*\d+"
NUMBERED_HEADING = r"(?m)^\s*\d+\.\d+(?:\.\d+)?\s+[A-Z]"
TOC_PATTERNS = (
    r"(?m)^\s*(\d+\.[\d\.]+)\s+([A-Z][^\.\n]{5,150}?)\s*\.{3,}\s*(\d+)\s*$",
    r"(?m)^\s*(\d+\.[\d\.]+)\s+([A-Z][^\n]{5,150}?)\s+(\d+)\s*$",
    r"(?m)^\s*(\d+\.[\d\.]+)\s+([A-Z][^\n]{5,150}?)\[[\d]+\]\s*\.{0,}\s*(\d+)\s*$",
    r"(\d+\.[\d\.]+)\s+([A-Z].*?)\s+\.{2,}\s*(\d+)",
)
HEADER_LINE = r"(?i)^JEDEC Standard No\."
FOOTER_CODE = r"JESD84-B\d+\s+\d+"
EXCLUDED_TITLES = (r"^Figure\s+\d+", r"^Table\s+\d+", r"^Figures?$", r"^Tables?$", r"^Contents?$", r"^Page\s+\d+", r"^Reserved", r"^JEDEC", r"^\w{1,3}$")
HEADING_PATTERNS = (r"^\d+\.\d+\.?\d*\s+\w+", r"^[A-Z]\.\d+\.?\d*\s+\w+", r"^Chapter\s+\d+", r"^Appendix\s+[A-Z]", r"^Section\s+\d+")
NOT_SUBTITLES = (r"JEDEC Standard No\.", r"Page \d+", r"^\d+\s*$", r"Copyright", r"All rights reserved", r"^Table \d+", r"^Figure \d+", r"^\d+\.\d+")
FIGURE = r"(?i)Figure\s+[\dA-Z]+-[\d]+"
TABLE = r"(?i)Table\s+[\dA-Z]+-[\d]+"
APPENDIX = r"(?i)Appendix\s+[A-Z]\.?[\d\.]*"
SECTION_LINE = r"(?m)^\s*(\d+\.[\d\.]+)\s+([A-Z][^\n]{0,200})"
SUBSECTION_LINE = r"(?m)^(\d+(?:\.\d+)+)[ \t]+([^\n]{5,200}?)[ \t]*$"
QUOTED_SUBTITLE = r'(?m)^[^\n]{0,100}?"([^"]{2,50})"'
CODE_SUBTITLE = r"(?m)^[^\n]{0,100}?\b([A-Z]{2,}[0-9]{2,})\b"
CONTINUED = r"(?i)\(cont['‘’]?d\)"
REGISTER_LINE = r"^\d+(\.\d+)+\s+[A-Z_]+(\s+\[[\d:]+\])?$"
HEAD_TAIL_MARK = "\n\n[... content truncated ...]\n\n"
HEAD_MARK = "\n\n[... content truncated ...]"
NO_ANSWER = ("i cannot answer", "not found in the context", "insufficient information", "context doesn't contain", "unable to determine")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), r"\s+"), lambda w: w != "")


def token_estimate(text) -> Column:
    return F.floor(F.length(_c(text)) / 4).cast("long")


def level(number) -> Column:
    return F.size(F.split(_c(number), r"\.")).cast("long")


def section_key(number) -> Column:
    """Numbers to sort a section by: 'Appendix ' and edge dots stripped, a part that is no number sorts as 999."""
    bare = F.regexp_replace(F.regexp_replace(_c(number), "^Appendix ", ""), r"^\.+|\.+$", "")
    return F.transform(F.split(bare, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)))


def parent_prefixes(number) -> Column:
    parts = F.split(_c(number), r"\.")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))).otherwise(F.array().cast("array<string>"))


def section_numbers(title) -> Column:
    """6.6.34.1 X -> [6,6,34,1]; B.2.6 X -> [2,6]; none -> []. A part too large for an int is left out."""
    t = F.trim(F.coalesce(_c(title), F.lit("")))
    own = F.regexp_extract(t, r"^[\d\.]+", 0)
    found = F.when(own != "", own).otherwise(F.regexp_extract(t, r"^(?:Appendix\s+)?[A-Z]\.?([\d\.]+)", 1))
    return F.filter(F.transform(F.split(found, r"\."), lambda p: p.try_cast("int")), lambda p: p.isNotNull())


def major_change(old, new, levels: int = 3) -> Column:
    """Whether the section changes for good between two titles; false if either is empty."""
    a, b = section_numbers(old), section_numbers(new)
    same = lambda n: F.slice(a, 1, n) == F.slice(b, 1, n)
    numbered = F.when(F.size(a) != F.size(b), True).otherwise(~same(F.lit(levels)))
    change = F.when((F.size(a) == 0) | (F.size(b) == 0), _c(old) != _c(new)).otherwise(numbered)
    return (F.coalesce(_c(old), F.lit("")) != "") & (F.coalesce(_c(new), F.lit("")) != "") & change


def common_parent(arrays) -> Column:
    """Longest common front of an array of arrays of numbers, as a dotted string ('' if none)."""
    a = _c(arrays)
    front = lambda x, y: F.slice(x, 1, F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(x), F.size(y))), lambda i: F.slice(x, 1, i) == F.slice(y, 1, i))))
    both = lambda x, y: F.when((F.size(x) == 0) | (F.size(y) == 0), F.array().cast("array<int>")).otherwise(front(x, y))
    return F.array_join(F.transform(F.aggregate(F.slice(a, F.lit(2), F.size(a)), F.get(a, F.lit(0)), both), lambda i: i.cast("string")), ".")


def compound_title(parent, n) -> Column:
    return F.when(_c(n) > 1, F.concat(_c(parent), F.lit(" (Multiple subsections)"))).otherwise(_c(parent))


def clean_toc_title(title) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(_c(title)), r"\s*\.{2,}\s*", " "), r"\s{2,}", " "))


def is_toc_page(text) -> Column:
    t = _c(text)
    return F.lower(t).contains("contents") | (F.regexp_count(t, F.lit(DOT_LEADER)) > 10) | (F.regexp_count(t, F.lit(NUMBERED_HEADING)) > 5)


def needs_correction(title) -> Column:
    t = F.coalesce(_c(title), F.lit(""))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return (t == "") | t.startswith("Figure") | t.startswith("Table") | t.isin("Tables", "Figures", "Contents") | (F.length(t) < 4) | ~t.rlike(r"\p{L}") | (words > 15)


def heading_level(text) -> Column:
    """Level of a valid section heading, null for one that is excluded."""
    t = F.trim(_c(text))
    excluded = F.lit(False)
    for p in EXCLUDED_TITLES:
        excluded = excluded | t.rlike(f"(?i){p}")
    by_pattern = F.lit(None).cast("long")
    for k, p in reversed(list(enumerate(HEADING_PATTERNS, 1))):
        by_pattern = F.when(t.rlike(p), F.lit(k).cast("long")).otherwise(by_pattern)
    plain = F.when(~t.rlike(r"\p{L}") | (F.size(F.split(t, r"\s+")) > 15), None).when(t.rlike(r"^\d+\s"), 1).otherwise(2)
    return F.when(~excluded & (F.length(t) >= 3) & (F.length(t) <= 120), F.coalesce(by_pattern, plain.cast("long")))


def heading_class(text) -> Column:
    """figure, table or appendix by the captions in a text, else section if it opens with a section's number, else other."""
    t = _c(text)
    return F.when(t.rlike(FIGURE), "figure").when(t.rlike(TABLE), "table").when(t.rlike(APPENDIX), "appendix").when(t.rlike(SECTION_LINE), "section").otherwise("other")


def title_flaws(title) -> Column:
    """short, all capitals, and shaped like a register's name."""
    t = _c(title)
    return F.struct((F.length(t) < 10).alias("short"), ((F.upper(t) == t) & (F.lower(t) != t)).alias("capitals"), t.rlike(r"^[A-Z0-9_]+$").alias("register"))


def feasibility(pct) -> Column:
    """Whether chunking by section numbers covers enough of the pages."""
    p = _c(pct)
    return F.when(p >= 95, "HIGH").when(p >= 80, "MEDIUM").otherwise("LOW")


def proceed(pct) -> Column:
    p = _c(pct)
    return F.when(p >= 95, "PROCEED").when(p >= 85, "CONSIDER").otherwise("STAY")


def default_pages(pages) -> Column:
    """Page numbers, page 1 where none is known."""
    p = _c(pages)
    return F.when(F.coalesce(F.size(p), F.lit(0)) > 0, p).otherwise(F.array(F.lit(1)))


def joined_path(titles, sep: str = " > ") -> Column:
    t = _c(titles)
    return F.when(F.size(t) > 0, F.array_join(t, sep))


def path_with_subtitle(path, sub) -> Column:
    return F.when(F.coalesce(_c(sub), F.lit("")) != "", F.concat(_c(path), F.lit(" - "), _c(sub))).otherwise(_c(path))


def iso_time(ts) -> Column:
    """A timestamp as its ISO text, to the microsecond only where it has any."""
    t = _c(ts)
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_trunc("second", t) == t, whole).otherwise(F.concat(whole, F.date_format(t, ".SSSSSS")))


def from_iso_time(text) -> Column:
    return F.to_timestamp(_c(text))


def level_by_length(text) -> Column:
    n = F.length(_c(text))
    return F.when(n < 30, 1).when(n < 60, 2).otherwise(3).cast("long")


def subtitle(text, number) -> Column:
    """Quoted text or a code of capitals and digits near a line's start, else a short capitalised line, of the first 500 characters."""
    t = F.substring(_c(text), 1, 500)
    quoted = F.nullif(F.trim(F.regexp_extract(t, QUOTED_SUBTITLE, 1)), F.lit(""))
    code = F.nullif(F.regexp_extract(t, CODE_SUBTITLE, 1), F.lit(""))

    def title(x: Column) -> Column:
        ok = (F.length(x) >= 5) & (F.length(x) <= 50) & x.rlike(r"^\p{Lu}") & ~F.startswith(x, _c(number)) & (~x.endswith(".") | (F.regexp_count(x, F.lit(" ")) <= 5))
        for p in NOT_SUBTITLES:
            ok = ok & ~x.rlike(f"(?i){p}")
        return ok

    lines = F.transform(F.slice(F.split(t, "\n"), 1, 10), lambda x: F.trim(x))
    return F.coalesce(quoted, code, F.get(F.filter(lines, title), F.lit(0)))


def _quoted(number) -> Column:
    return F.concat(F.lit(r"\Q"), F.regexp_replace(_c(number), r"\.+$", ""), F.lit(r"\E"))


def clean_content(text, number, header: str = HEADER_LINE, footer: str = FOOTER_CODE) -> Column:
    """Section content without running headers, footers, page numbers, its own number and continuation lines, with white space evened out."""
    own = _quoted(number)

    def stays(line: Column) -> Column:
        x = F.trim(line)
        continued = x.rlike(CONTINUED) & (F.length(x) < 80) & ~x.endswith(".")
        gone = x.rlike(header) | x.rlike(r"(?i)^Page \d+$") | x.rlike(rf"^{footer}$") | continued | x.rlike(REGISTER_LINE)
        return ~gone & ~F.rlike(x, F.concat(F.lit("^"), own, F.lit(r"\.?\s*$")))

    out = F.array_join(F.filter(F.split(F.coalesce(_c(text), F.lit("")), "\n"), stays), "\n")
    out = F.regexp_replace(out, r"^(?:[ \t]*\n)+", "")
    out = F.regexp_replace(out, F.concat(F.lit(r"(?m)^\s*"), own, F.lit(r"\s+")), F.lit(""))
    for pattern, by in ((footer, ""), (r"\n{3,}", "\n\n"), (r" {2,}", " "), (r"[ \t]+\n", "\n"), (r"^\s+|\s+$", "")):
        out = F.regexp_replace(out, pattern, by)
    return out


def recovered_title(text, number) -> Column:
    """Title that follows a section's number in the first 2000 characters; null if it looks like content."""
    pattern = F.concat(_quoted(number), F.lit(r"\s+([A-Z][^\n]{2,80}?)(?:\n|$|\.\.\.)"))
    t = F.trim(F.call_function("regexp_extract", F.substring(_c(text), 1, 2000), F.concat(F.lit("(?m)"), pattern), F.lit(1)))
    t = F.regexp_replace(F.regexp_replace(t, r"[.,;:]\s*$", ""), r"(?i)\s*\(cont['’]?d\)\s*$", "")
    bad = (F.length(t) > 80) | ~t.rlike(r"\p{L}") | t.startswith("Page ") | t.rlike(r"^\d+:") | (F.regexp_count(t, F.lit(":")) > 1) | ((F.length(t) < 5) & (F.upper(t) != t))
    return F.when((t != "") & ~bad, t)


def sentences(text) -> Column:
    return F.split(_c(text), r"(?<=[.!?])\s+")


def citations(answer) -> Column:
    """Distinct [n] of an answer, in order; a number too large for a long cites nothing."""
    found = F.transform(F.regexp_extract_all(F.coalesce(_c(answer), F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.try_cast("long"))
    return F.array_distinct(F.filter(found, lambda n: n.isNotNull()))


def keyword_overlap(question, text) -> Column:
    body = F.lower(_c(text))
    return F.size(F.filter(F.split(F.lower(_c(question)), r"\s+"), lambda w: (F.length(w) > 3) & F.contains(body, w))).cast("long")


def confidence(top_score, answer) -> Column:
    """From the best hit's score: an admitted lack of an answer halves it, no citation costs 40 %, a cited answer gains 10 %."""
    s, a = _c(top_score), F.lower(F.coalesce(_c(answer), F.lit("")))
    lost = F.lit(False)
    for phrase in NO_ANSWER:
        lost = lost | a.contains(phrase)
    cited = a.rlike(r"\[\d+\]")
    return F.when(s.isNull(), 0.0).when(lost, F.greatest(F.lit(0.3), s * 0.5)).when(~cited, F.greatest(F.lit(0.4), s * 0.6)).otherwise(F.least(F.lit(1.0), s * 1.1))


def head_and_tail(text, most: int = 2000, marker: str = HEAD_TAIL_MARK) -> Column:
    t, half = _c(text), most // 2
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, half), F.lit(marker), F.right(t, F.lit(half)))).otherwise(t)


def head(text, most: int = 2500, marker: str = HEAD_MARK) -> Column:
    t = _c(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(marker))).otherwise(t)


def preview(text, most: int = 200) -> Column:
    return F.concat(F.substring(_c(text), 1, most), F.lit("..."))


def page_list(pages) -> Column:
    return F.coalesce(F.nullif(F.array_join(_c(pages), ", "), F.lit("")), F.lit("N/A"))


def document_id(protocol, version, content) -> Column:
    return F.translate(F.concat_ws("_", _c(protocol), _c(version), F.substring(F.md5(_c(content)), 1, 8)), ". ", "__")


def stable_id(*parts) -> Column:
    return F.sha2(F.concat_ws(":", *[_c(p).cast("string") for p in parts]), 256)


def json_of_answer(text, schema: str) -> Column:
    """A JSON object from a model's text: as it is, else from its fenced block."""
    t = _c(text)
    inside = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    whole = F.when(F.ltrim(t).startswith("{"), F.from_json(t, schema))
    return F.coalesce(whole, F.when(inside != "", F.from_json(inside, schema)))


def near_pages(pages, expected, within: int = 2) -> Column:
    """Whether any of some pages lies within so many of the expected one; false without pages."""
    return F.coalesce(F.exists(_c(pages), lambda p: F.abs(p - _c(expected)) <= within), F.lit(False))


def evaluation_points(path, title, text, pages, question, section, sub, page) -> Column:
    """The five parts, 0 to 5 each, of how well a top hit (``path``, ``title``, ``text``, ``pages``) answers a question that expects ``section``, ``sub`` and ``page`` (null: nothing expected)."""
    p, t, want = _c(path), _c(text), _c(page)
    holds = lambda whole, part: F.contains(F.lower(whole), F.lower(part))
    flawed = F.contains(p, F.lit("[Inferred]")) | F.contains(F.lower(p), F.lit(".part")) | (F.contains(p, F.lit("Page ")) & ~F.contains(_c(title), F.lit("Page ")))
    last = F.element_at(F.split(p, " - "), -1)
    known = F.coalesce(_c(sub), F.lit("")) != ""
    own = (
        F.when(~F.contains(p, F.lit(" - ")), 3).when(F.contains(last, F.lit("Table ")) | F.contains(last, F.lit("Figure ")), 2).when(known & holds(last, F.coalesce(_c(sub), F.lit(""))), 5)
        .when(F.contains(F.substring(t, 1, 500), last), 4).otherwise(2)
    )
    exact = F.coalesce(F.array_contains(_c(pages), want), F.lit(False))
    words = keyword_overlap(question, t)
    parts = {
        "retrieval_accuracy": F.when(F.coalesce(_c(section), F.lit("")) == "", 4).when(holds(p, _c(section)), 5).otherwise(2), "section_path_quality": F.when(flawed, 2).otherwise(5), "subtitle_accuracy": own,
        "citation_accuracy": F.when(want.isNull() | (want == 0), 4).when(exact, 5).when(near_pages(pages, want), 4).otherwise(2), "content_completeness": F.when(words >= 3, 5).when(words >= 2, 4).otherwise(3),
    }
    return F.struct(*[v.cast("long").alias(k) for k, v in parts.items()])


def evaluation_grade(pct) -> Column:
    p = _c(pct)
    return F.when(p >= 90, "EXCELLENT").when(p >= 75, "GOOD").when(p >= 60, "ACCEPTABLE").otherwise("NEEDS WORK")


def grade(rate) -> Column:
    r = _c(rate)
    return F.when(r >= 0.9, "A").when(r >= 0.8, "B").when(r >= 0.7, "C").otherwise("D-F")
