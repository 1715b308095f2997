"""Personal data: patterns, and terms that reveal whom they stand near.

The patterns give the protected entities (an address, a number), and so do words whose characters carry too much information to be language
(keys and tokens: kind ``secret``). Each value is an entity, and each kind is one too, which all its mentions share. Corpus co-occurrence then estimates how strongly a term,
a word or two in a row, reveals one: over all texts, the share of the term's occurrences that stand within ``WINDOW`` words of the entity on a line, P(e | t),
and the information log2 P(e | t) / P(e) as a part of the most there is to learn of the entity, -log2 P(e): a term that is only ever seen
near its entity has all of it, however frequent the entity or small the corpus. P(e | t) is smoothed, as if ``PRIOR`` more uses of the term
had stood near the entity as often as any word does, so one use alone never decides; for pairs of words and for kinds, uses must be on ``LINES`` different
lines, as copies of one text would decide for every pair in it. A term with P(e | t) >= ``SHARE`` and ``LIFT`` of
that information or more is disclosed: each of its occurrences becomes a span, which ``sanitise`` generalises or removes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .runtime import apply_in_passes, discard, materialize, releasing, set_slices, sorted_lookup

WINDOW, SHARE, LIFT, PRIOR = 8, 0.5, 0.5, 2.0
LINES = 2
#: Words of so many characters with letters and digits, and so many bits a character in their own distribution, are secrets.
SECRET_CHARS, SECRET_BITS = 20, 3.0
#: Floors that ``disclosing_terms`` takes by default and the spans do not: different lines, and whole bits, which leave out frequent
#: entities and small corpora.
SUPPORT, BITS = 3, 10.0
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is taken whole or not at all, as in the patterns without possessive repeats: what may follow is never a digit.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_ANY_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(rf"[A-Za-z0-9+/_-]{{{SECRET_CHARS},}}")


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def find(text: str) -> list[tuple[str, int, int]]:
    """The base spans (kind, start, end) in code points, by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _ANY_DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def secrets(text: str) -> list[tuple[str, int, int]]:
    """Spans of words that carry too much information: letters and digits mixed, at ``SECRET_BITS`` a character or more."""
    out = []
    for m in _TOKEN.finditer(text) if _ANY_DIGIT.search(text) else ():
        word = m[0]
        digits, letters = sum(c.isdigit() for c in word), sum(c.isalpha() for c in word)
        if digits >= 4 and letters >= 4:
            n = np.unique(np.frombuffer(word.encode(), np.uint8), return_counts=True)[1] / len(word)
            if -(n * np.log2(n)).sum() >= SECRET_BITS:
                out.append(("secret", *m.span()))
    return out


def protected(text: str) -> list[tuple[str, int, int]]:
    """The base spans, and secrets that lie apart from them."""
    base = find(text)
    return base + [s for s in secrets(text) if not any(s[1] < b and a < s[2] for _, a, b in base)]


def kind_entity(kind: str) -> int:
    """Number of the entity that all mentions of a kind are."""
    return xxhash.xxh64_intdigest(f"kind:{kind}".encode(), 7) - (1 << 63)


def entity(kind: str, value: str) -> int:
    """Number of the entity that a match names: letter case and separators aside."""
    own = value.lower() if kind in ("email", "ip") else value if kind == "secret" else _NOT_DIGIT.sub("", value)
    return xxhash.xxh64_intdigest(f"{kind}:{own}".encode(), 7) - (1 << 63)


def _byte_places(raw: np.ndarray) -> np.ndarray:
    """The byte at which each character begins, and the end."""
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def _pairs(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of two words in a row, and which of them lie in one document."""
    g = kernel.grams(h, 2)
    inside = np.ones(len(g), bool)
    last = w[1:-1] - 1
    inside[last[(last >= 0) & (last < len(g))]] = False
    return g, inside


def _context_pass(batches):
    """(entity, term, pair, line) for every term near a mention; (null, null, null, number of words) for each batch."""
    for batch in batches:
        data, off = kernel.text_bytes(batch.column("text"))
        total, ents, terms, pair, lines = 0, [], [], [], []
        for i, j in kernel.pieces(off):
            block = data[off[i] : off[j]]
            o = off[i : j + 1] - off[i]
            h, start, end, w = kernel.words(block, o, kernel.ALNUM)
            total += len(h)
            for k in range(j - i):
                raw = block[o[k] : o[k + 1]].tobytes()
                text = raw.decode()
                spans = protected(text)
                if not spans:
                    continue
                place = _byte_places(block[o[k] : o[k + 1]])
                s, e = start[w[k] : w[k + 1]] - o[k], end[w[k] : w[k + 1]] - o[k]
                own = h[w[k] : w[k + 1]]
                two = kernel.grams(own, 2)
                taken = np.zeros(len(s), bool)
                at = [(kind, text[a:b], int(place[a]), int(place[b])) for kind, a, b in spans]
                for _, _, a, b in at:
                    taken[np.searchsorted(e, a, "right") : np.searchsorted(s, b)] = True
                beside = {}
                for kind, value, a, b in at:
                    la, lb = raw.rfind(b"\n", 0, a) + 1, raw.find(b"\n", b)
                    lb = len(raw) if lb < 0 else lb
                    left, right = int(np.searchsorted(e, a, "right")), int(np.searchsorted(s, b))
                    lo, hi = max(left - WINDOW, int(np.searchsorted(s, la))), min(right + WINDOW, int(np.searchsorted(e, lb, "right")))
                    near = np.concatenate((np.arange(lo, left), np.arange(right, max(hi, right))))
                    near = near[~taken[near]]
                    line = xxhash.xxh64_intdigest(raw[la:lb], 7) - (1 << 63)
                    for x in (entity(kind, value), kind_entity(kind)):
                        beside.setdefault(x, {}).update(dict.fromkeys(near.tolist(), line))
                for ent, places in beside.items():
                    p = np.fromiter(places, np.int64, len(places))
                    line = np.fromiter(places.values(), np.int64, len(places))
                    order = np.argsort(p)
                    p, line = p[order], line[order]
                    first = np.flatnonzero(np.diff(p) == 1)
                    ents.append(np.full(len(p) + len(first), ent, np.int64))
                    terms.append(np.concatenate((own[p], two[p[first]])).view(np.int64))
                    pair.append(np.concatenate((np.zeros(len(p), bool), np.ones(len(first), bool))))
                    lines.append(np.concatenate((line, line[first])))
        cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ents, terms, lines)]
        flags = np.concatenate(pair) if pair else np.zeros(0, bool)
        out = [pa.array([*x, y], pa.int64()) for x, y in zip(cols, (None, None, total))]
        yield pa.record_batch([out[0], out[1], pa.array([*flags.tolist(), None], pa.bool_()), out[2]], names=["entity", "term", "pair", "line"])


def disclosing_terms(docs: DataFrame, support: int = SUPPORT, share: float = SHARE, bits: float = BITS) -> DataFrame:
    """``(term, entity, near, uses, share, bits)``: terms (by hash) over the thresholds, from counts over all texts.

    The smoothed share and ``LIFT`` always decide; ``support`` (1: none) and ``bits`` (0: none) are floors besides. An occurrence near
    several mentions of one entity counts once; each copy of a line counts (but see ``LINES``).
    """
    seen = materialize(docs.select("text").mapInArrow(releasing(_context_pass), "entity long, term long, pair boolean, line long").groupBy("entity", "term", "pair", F.when(F.col("entity").isNotNull(), F.col("line")).alias("line")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("entity").isNull(), F.col("line"))).alias("words")), "contexts")
    words = seen.where("entity is null").agg(F.sum("words")).first()[0] or 0
    kinds = [kind_entity(k) for k in KINDS]
    pairs = seen.where("entity is not null").groupBy("entity", "term").agg(F.sum("n").alias("near"), F.count("*").alias("lines"), F.max("pair").alias("pair"))
    # the words near an entity: pairs of words are not counted beside
    mass = materialize(pairs.where("not pair").groupBy("entity").agg(F.sum("near").alias("mass")), "mass")
    least = F.greatest(F.lit(support), F.when(F.col("pair") | F.col("entity").isin(kinds), LINES).otherwise(1))
    some = pairs.where((F.col("lines") >= least) & (F.col("near") > 1))
    # a kind's pairs may be a good part of all: its mass is sent, those of values meet theirs by a shuffle
    of_kind = some.where(F.col("entity").isin(kinds)).join(F.broadcast(mass.where(F.col("entity").isin(kinds))), "entity")
    of_value = some.where(~F.col("entity").isin(kinds)).join(mass.where(~F.col("entity").isin(kinds)), "entity")
    pairs = of_kind.unionByName(of_value).withColumn("p", F.col("mass") / F.lit(float(max(words, 1))))
    smooth = lambda uses: (F.col("near") + PRIOR * F.col("p")) / (uses + PRIOR)
    decides = lambda x: (x >= share) & (x > F.col("p")) & (F.log2(x / F.col("p")) >= -LIFT * F.log2("p"))
    # A term has at least the uses that stand near: what fails with no others fails with any.
    pairs = materialize(pairs.where(decides(smooth(F.col("near")))), "pairs")
    discard(seen, mass)
    n, read = set_slices(pairs.select("term"))
    uses = []
    for k in range(n):
        if len(terms := read(k)):
            uses.append(materialize(_count_uses(docs, terms), "uses"))
    if not uses:
        return pairs.select("term", "entity", "near", F.lit(0).cast("long").alias("uses"), F.lit(0.0).alias("share"), F.lit(0.0).alias("bits")).where("false")
    every = uses[0]
    for more in uses[1:]:
        every = every.union(more)
    out = pairs.join(every, "term").withColumn("share", F.col("near") / F.col("uses"))
    out = out.where(decides(smooth(F.col("uses")))).withColumn("bits", F.log2(F.col("share") / F.col("p")))
    return out.where(F.col("bits") >= bits).select("term", "entity", "near", "uses", "share", "bits")


def _count_uses(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        inside = sorted_lookup(sent.value)
        n = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            data, off = kernel.text_bytes(batch.column("text"))
            for i, j in kernel.pieces(off):
                h, _, _, w = kernel.words(data[off[i] : off[j]], off[i : j + 1] - off[i], kernel.ALNUM)
                two, whole = _pairs(h, w)
                for own in (h, two[whole]):
                    np.add.at(n, np.searchsorted(sent.value, own[inside(own)].view(np.int64)), 1)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(sent.value[some]), pa.array(n[some])], names=["term", "uses"])

    return docs.select("text").mapInArrow(releasing(run), "term long, uses long").groupBy("term").agg(F.sum("uses").alias("uses"))


def annotate(docs: DataFrame, support: int = 1, share: float = SHARE, bits: float = 0.0) -> DataFrame:
    """Add ``_spans`` (array of (kind, start, end) in code points: base kinds in their order, secrets, disclosing terms) to ``docs(text, ...)``.

    Null and empty texts have none. Terms inside another span get no span of their own, pairs of words none where one of them is a term. Columns pass through; a row per input row, repeated rows too
    (their mentions count each). Empty tables give no rows.
    """
    n, read = set_slices(disclosing_terms(docs, support, share, bits).select("term"))
    docs = docs.select(*docs.columns, F.lit(None).cast("array<struct<kind:string,start:int,end:int>>").alias("_spans"))
    schema = docs.schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def one_pass(d: DataFrame, terms: np.ndarray) -> DataFrame:
        sent = d.sparkSession.sparkContext.broadcast(terms)

        def run(batches):
            inside = sorted_lookup(sent.value)
            for batch in batches:
                data, off = kernel.text_bytes(batch.column("text"))
                spans = batch.column("_spans").to_pylist()
                for i, j in kernel.pieces(off):
                    block, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                    if len(sent.value):
                        h, start, end, w = kernel.words(block, o, kernel.ALNUM)
                        hit = inside(h)
                        two, whole = _pairs(h, w)
                        both = inside(two)
                        both = both[whole[both]]
                        cut, cut2 = np.searchsorted(hit, w), np.searchsorted(both, w)
                    for k in range(j - i):
                        raw = block[o[k] : o[k + 1]].tobytes()
                        text = raw.decode()
                        own = [(x["kind"], x["start"], x["end"]) for x in spans[i + k]] if spans[i + k] is not None else protected(text)
                        if len(sent.value) and (cut[k + 1] > cut[k] or cut2[k + 1] > cut2[k]):
                            # characters before each byte, and those in a span
                            before = np.concatenate(([0], np.cumsum((block[o[k] : o[k + 1]] & 0xC0) != 0x80)))
                            held = np.zeros(len(text) + 1, bool)
                            for _, a, b in own:
                                held[a:b] = True
                            for found, size in ((hit[cut[k] : cut[k + 1]], 1), (both[cut2[k] : cut2[k + 1]], 2)):
                                for x in found.tolist():
                                    a, b = int(before[start[x] - o[k]]), int(before[end[x + size - 1] - o[k]])
                                    if not held[a:b].any():
                                        own.append(("term", a, b))
                                        held[a:b] = True
                        spans[i + k] = [{"kind": c, "start": a, "end": b} for c, a, b in sorted(own, key=lambda x: (KINDS.index(x[0]), x[1]))]
                names = batch.schema.names
                yield pa.record_batch([pa.array(spans, kind) if c == "_spans" else batch.column(k) for k, c in enumerate(names)], names=names)

        return d.mapInArrow(releasing(run), schema)

    return apply_in_passes(docs, n, read, one_pass, "annotated")


def sanitise(docs: DataFrame, remove: bool = False, **thresholds) -> DataFrame:
    """The documents with every span's text generalised to its kind (``[EMAIL]``, ``[TERM]``), or removed; columns as they come."""
    found = annotate(docs, **thresholds)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k, spans in enumerate(batch.column("_spans").to_pylist()):
                if spans:
                    out, at = [], 0
                    for s in sorted(spans, key=lambda x: (x["start"], -x["end"])):
                        if s["start"] >= at:
                            out += [texts[k][at : s["start"]], "" if remove else f"[{s['kind'].upper()}]"]
                        at = max(at, s["end"])
                    texts[k] = "".join([*out, texts[k][at:]])
            names = batch.schema.names
            yield pa.record_batch([pa.array(texts, pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(names)], names=names)

    return found.mapInArrow(releasing(run), found.schema).select(*docs.columns)


def report(docs: DataFrame, **thresholds) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term, n_spans)``, a row per document."""
    found = annotate(docs.select("doc_id", "text"), **thresholds)
    listed = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    n = {k: of(k) for k in KINDS}
    base = F.filter("_spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[n[k] for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"), n["secret"], n["term"], F.size("_spans").cast("long").alias("n_spans"))
