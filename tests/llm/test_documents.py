"""Operators over documents against brute force, on the smallest table and awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import decontaminate, kernel, line_dedup, mixing, ngram_join, pii, quality, token_files
from textloom.llm.queries import TOKENIZER

from .conftest import ALNUM, LOWER, SPACED


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_statistics(docs, texts):
    got = by_id(quality.statistics(docs))
    assert len(got) == len(texts)
    for i, t in texts.items():
        t = t or ""
        w = SPACED.findall(t)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        often = Counter(windows)
        again = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if SPACED.search(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))


def test_binomial_bound(spark):
    from math import comb

    rows = [(k, n) for n in (5, 50, 400) for k in (0, 1, 4, n // 10)]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", quality.binomial_cdf(F.col("k"), F.col("n"), 0.07).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(sum(comb(r.n, i) * 0.07**i * 0.93 ** (r.n - i) for i in range(r.k + 1)), rel=1e-9)


def test_cutoffs_are_certified_and_limited(spark):
    """Good texts have few symbols, bad ones many: a cutoff between is found, and no good text beyond the bound is lost; a small stratum gets none."""
    rows = [(i, "a", 100, 500, 1 if i % 4 else 200, 0, 0) for i in range(20_000)] + [(i, "b", 100, 500, 200, 0, 0) for i in range(20_000, 20_050)]
    stats = spark.createDataFrame([(*r, False) for r in rows], "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    labels = spark.createDataFrame([(r[0], int(r[4] == 1), 0) for r in rows], "doc_id long, quality int, toxic int")
    got = {r.stratum: r for r in quality.certified_cutoffs(stats, labels).collect()}
    assert 2 < got["a"].symbols < 400 and got["a"].repeats is None
    assert "b" not in got
    assert quality.certified_cutoffs(stats.limit(0), labels).count() == 0


def test_judged_and_kept_documents(spark):
    """kept, failed_rules and the documents that stay, against the rules worked out by hand; symbols are certified, rare languages are not."""
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows = [(i, prose(30), "en", 1) for i in range(400)] + [(400 + i, prose(30) + " ####", "en", 0) for i in range(60)]
    rows += [(500 + i, prose(30) + " ####", "xx", 0) for i in range(5)] + [(600, prose(4), "en", None), (601, None, "en", None), (602, "a b c d e " * 9, "en", None)]
    rows += [(700, prose(30) + " ####", "en", None), (701, prose(30), "en", None), (702, prose(30) + " ####", None, None)]
    frame = spark.createDataFrame([(i, t, lang, "s") for i, t, lang, _ in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, _, q in rows if q is not None], "doc_id long, quality int, toxic int")
    judged = by_id(quality.judge(frame, labels))
    marked = {i for i, t, lang, _ in rows if t and "#" in t and lang == "en"}
    assert len(judged) == len(rows) and {i for i, r in judged.items() if r.base_failed} == {600, 601, 602}
    assert {i for i, r in judged.items() if r.failed_rules} == marked and {i for i in marked if judged[i].failed_rules != ["symbols"]} == set()
    want = {i for i, *_ in rows} - marked - {600, 601, 602}
    assert {i for i, r in judged.items() if r.kept} == want
    stay = quality.keep_good(frame, labels)
    assert stay.columns == frame.columns and stay.count() == len(want)
    assert {r.doc_id: (r.text, r.lang, r.source) for r in stay.collect()} == {i: (t, lang, "s") for i, t, lang, _ in rows if i in want}


def test_a_few_hundred_good_labels_certify_all_rules_together(spark):
    """320 clean good labels a stratum do, 100 do not; a cutoff that only rejects good texts is not taken, and no stratum loses over 2 %."""
    rows = []
    for stratum, good in (("x", 320), ("y", 320), ("rare", 100)):
        rows += [(stratum, 100, 500, 1, 0, 0, True) for _ in range(good - 20)] + [(stratum, 100, 500, 1, 0, 9, True) for _ in range(20)]
        rows += [(stratum, 100, 500, 200, 0, 0, False) for _ in range(40)] + [(stratum, 100, 500, 1, 30, 0, False) for _ in range(40)]
    names = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    stats = spark.createDataFrame([(i, *r[:6], False) for i, r in enumerate(rows)], names)
    labels = spark.createDataFrame([(i, int(r[6]), 0) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = {r.stratum: r for r in quality.certified_cutoffs(stats, labels).collect()}
    assert set(got) == {"x", "y"}
    for r in got.values():
        assert 2 < r.symbols < 400 and 0 < r.dup_lines < 30 and r.repeats is None and r.long_words is None and r.short_words is None


def test_ngram_components(docs, texts):
    sets = {}
    for i, t in texts.items():
        w = SPACED.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            having[g].append(i)
    common = Counter((a, b) for own in having.values() for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), o in common.items():
        if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = by_id(ngram_join.similar_components(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), find(i)) for i in sets}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i in sets if find(i) == i)


def test_ngram_components_near_the_threshold(spark):
    """Chains and families whose links lie around the threshold, so that pivots fail and the exhaustive trees must find what they miss."""
    rng = random.Random(11)
    rows = []
    for family in range(6):
        text = [f"w{family}x{k}" for k in range(60)]
        for step in range(40):
            own = list(text)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(60)] = f"e{rng.randrange(9)}"
            rows.append((len(rows), " ".join(own)))
            if step % 8 == 7:
                text[rng.randrange(60)] = f"d{step}"
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            o = len(sets[a] & sets[b])
            if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(frame).collect()}
    assert got == {i: find(i) for i in sets}
    # the exhaustive step alone, from no links at all, in blocks
    size, ngram_join.TREE_SETS = ngram_join.TREE_SETS, 7
    try:
        base = ngram_join.ordered_sets(frame).where("toks is not null")
        own = base.groupBy("sig").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("toks").alias("toks"))
        mixed = own.select(F.lit(1).alias("key"), "sig", F.when(F.col("low") % 3 == 0, F.lit(b"a")).otherwise(F.col("sig")).alias("comp"))
        found = ngram_join._exhaust(mixed, own, 4, 5).collect()
        of = {bytes(r.sig): r.low for r in own.collect()}
        together = {i: i for i in of.values()}

        def top(x):
            while together[x] != x:
                x = together[x]
            return x

        pairs = [(of[bytes(r.u)], of[bytes(r.v)]) for r in found]
        pairs += [(0, i) for i in together if i % 3 == 0]
        for a, b in pairs:
            x, y = top(a), top(b)
            together[max(x, y)] = min(x, y)
        for a in together:
            for b in together:
                o = len(sets[a] & sets[b])
                if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                    assert top(a) == top(b)
    finally:
        ngram_join.TREE_SETS = size


def test_ngram_repeated_rows_and_null_ids(spark):
    t = " ".join(f"v{k}" for k in range(30))
    rows = [(5, t), (5, t), (None, t), (7, t + " z"), (None, "alone here"), (9, None)]
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (7, 5), (None, None), (9, 9)], key=str)
    rows += [(5, "another text of the same id"), (None, "alone here"), (12, None), (12, None), (-3, t)]
    odd = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, id int").withColumns({"row_key": F.lit(1), "same": F.lit(True), "odd": F.lit(0)})
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(-3, t), (None, "alone here"), (9, None), (5, "another text of the same id"), (12, None), (12, None)], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_components(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


@pytest.mark.parametrize("bits", [6, 15, 16, 18])
def test_ordered_sets_at_many_ranges(bits, monkeypatch):
    """Blocks with more frequent shingles than there are places for them, and ranges beyond 16 bits: every document keeps its shared shingles, in one order for all."""
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 10**7)
    rng = random.Random(bits)
    common = [f"c{k}" for k in range(6200)]
    texts = [" ".join(common + [f"own{i}x{k}" for k in range(40)]) for i in range(ngram_join.OFTEN + 2)]
    texts += [" ".join(rng.choice("abc") for _ in range(400)) for _ in range(6)] + ["a b c", None, "a b c"]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in ((t or "").split() for t in texts)]
    shared = Counter(s for one in sets for s in one)
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    ranged = _with_task(lambda: list(ngram_join._hash_pass(5, bits)(iter([batch]))))
    ranged = pa.Table.from_batches(ranged)
    assert len(pa.ipc.open_stream(ranged.filter(ranged["meta"])["b"][0].as_py()).read_all()["cut"][0]) - 1 == ngram_join.OFTEN_PLACES
    r = ranged["r"].to_numpy()
    order = np.argsort(r, kind="stable")
    cut = np.append(np.flatnonzero(np.diff(r[order], prepend=-1)), len(r))
    numbered = pa.concat_tables([ngram_join._count_range(ranged.take(pa.array(order[a:b]))) for a, b in zip(cut, cut[1:])])
    got = ngram_join._gather_block(4, 5)(numbered).to_pylist()
    number = {}
    for i, row in enumerate(got):
        n_shared = sum(shared[s] > 1 for s in sets[i])
        live = sets[i] and 4 * len(sets[i]) <= 5 * n_shared
        assert row["doc_id"] == i and row["n"] == len(sets[i]) and (row["toks"] is not None) == bool(live)
        if live:
            toks = ngram_join.unpack(row["toks"])
            assert len(toks) == n_shared and (np.diff(toks) > 0).all()
            number[i] = set(toks.tolist())
    for a, b in [*zip(number, list(number)[1:]), *(rng.sample(sorted(number), 2) for _ in range(60))]:
        assert len(number[a] & number[b]) == len(sets[a] & sets[b])


def _with_task(run):
    from unittest import mock

    with mock.patch.object(ngram_join.TaskContext, "get", lambda: mock.Mock(partitionId=lambda: 0)):
        return run()


@pytest.mark.parametrize("seed", range(5))
def test_prefix_tree(seed):
    rng = random.Random(seed)
    pool = sorted(rng.sample(range(10**6), 40))
    sets = [np.array(sorted(rng.sample(pool, rng.randint(1, 30)))) for _ in range(200)]
    sets += sets[:5]
    sizes = [len(s) + rng.randint(0, 2) for s in sets]
    tree = ngram_join.PrefixTree(sets, sizes)
    for i in range(0, 200, 7):
        want = {j for j, s in enumerate(sets) if 9 * len(set(s) & set(sets[i])) >= 4 * (sizes[i] + sizes[j])}
        assert set(tree.walk(sets[i], sizes[i], 4, 5)) == want


def test_decontamination(spark, docs, texts, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("item_id"), "text")
    more = [("t1", "One, two THREE"), ("t2", None), ("t3", "..."), ("t4", "東京"), ("t1", "One, two THREE"), (None, "other")]
    bench = bench.union(spark.createDataFrame(more, "item_id string, text string"))
    of = defaultdict(set)
    for r in bench.collect():
        w = ALNUM.findall((r.text or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            of[tuple(w[k : k + n])].add(r.item_id or "")
    lengths = {len(k) for k in of}
    for most in (decontaminate.MOST_BYTES, 900):
        got = by_id(decontaminate.report(docs, bench, most_bytes=most))
        for i, t in texts.items():
            w = ALNUM.findall((t or "").translate(LOWER))
            hit, items = set(), set()
            for n in lengths:
                for k in range(len(w) - n + 1):
                    if own := of.get(tuple(w[k : k + n])):
                        hit.update(range(k, k + n))
                        items |= own
            r = got[i]
            want = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want, i
    clean = decontaminate.remove_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r.contaminated for r in got.values())
    cut = by_id(decontaminate.remove_spans(docs, bench))
    again = decontaminate.report(docs.where("doc_id = 10000004"), bench).first()
    assert again.n_hit == 3 and cut[10_000_004].text == "" and len(cut) == len(texts)
    assert not any(r.contaminated for r in decontaminate.report(docs.limit(9), bench.limit(0)).collect())


def test_mixing(spark, docs, texts):
    got = mixing.mix(docs).collect()
    sizes = {i: len(SPACED.findall(t or "")) for i, t in texts.items()}
    assert {r.doc_id: r.size for r in got} == sizes
    totals = Counter()
    for r in got:
        totals[r.source] += r.size
    order = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, capped = 1.5 * sum(totals.values()), {}
    while True:
        left = {s: w for s, w in weight.items() if s not in capped}
        level = (budget - sum(capped.values())) / sum(left.values()) if left else 0
        over = {s: 2.0 * totals[s] for s, w in left.items() if level * w > 2 * totals[s]}
        if not over:
            break
        capped |= over
    target = {s: capped.get(s, level * weight[s]) for s in weight}
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == totals[r.source]
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in totals:
        # whole copies cannot come nearer than half of the largest document, should it outweigh the rest
        most = max(r.size for r in got if r.source == s)
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + (60 if 2 * most < totals[s] else most / 2)
    assert sorted(got, key=str) == sorted(mixing.mix(docs.repartition(7)).collect(), key=str)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_entropy_balance_is_the_optimum(spark):
    """The tilt keeps log-odds linear in size, as stationarity asks, and meets the tokens."""
    rows = [("s", k, 10) for k in range(1, 40)]
    total = sum(k * n for _, k, n in rows)
    goals = spark.createDataFrame([("s", total, 0.3 * total, 20.0)], "source string, total long, target double, mean double")
    lam = mixing.tilts(spark.createDataFrame(rows, "source string, size long, n long"), goals).first().lam
    rate = [2 / (1 + np.exp(-lam * k / 20)) for _, k, _ in rows]
    assert sum(r * k * n for r, (_, k, n) in zip(rate, rows)) == pytest.approx(0.3 * total, abs=1)


def test_token_files(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER())
    shuffled = docs.union(docs.where("doc_id % 50 = 0")).repartition(5)
    manifest = token_files.write(shuffled, f"file://{tmp_path}/t", TOKENIZER(), by_word=True, shard_tokens=50_000)
    assert manifest.count() > 2
    got = token_files.read_digests(manifest).orderBy("start").collect()
    want, at = [], 0
    for i, t in sorted([(i, t or "") for i, t in texts.items()] + [(i, t or "") for i, t in texts.items() if i % 50 == 0]):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    whole = token_files.encode_all(docs, TOKENIZER()).orderBy("start").select("n_tokens").collect()
    assert len(whole) == len(texts)
    assert token_files.encode_all(docs.limit(0), TOKENIZER()).count() == 0


@pytest.mark.parametrize("n,top", [(0, 3), (1, 1), (9, 3), (5000, 60_000), (4096, 7)])
def test_wavelet_file(n, top):
    a = np.random.default_rng(n).integers(0, top, n).astype(np.uint16)
    f = token_files.WaveletFile(token_files.WaveletFile.encode(a, [4, None], np.array([n, 0]), 2))
    assert (f.ids() == a).all() and f.documents()[0] == [4, None] and f.documents()[1].tolist() == [n, 0]
    for i in range(0, n, max(1, n // 40)):
        s = int(a[i])
        assert f.access(i) == s and f.rank(s, i) == (a[:i] == s).sum() and f.select(s, f.rank(s, i)) == i
        assert f.count(s, i // 2, i) == (a[i // 2 : i] == s).sum()
    assert f.count(top + 70_000) == 0


def test_personal_data(docs, texts):
    got = by_id(pii.report(docs))
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def luhn(m):
        d = [int(c) for c in m if c.isdigit()]
        return 13 <= len(d) <= 19 and sum(d[::-1][::2]) + sum(2 * x - 9 * (x > 4) for x in d[::-1][1::2]) and (sum(d[::-1][::2]) + sum(2 * x - 9 * (x > 4) for x in d[::-1][1::2])) % 10 == 0

    tests = [("email", email, lambda m: True), ("ip", ip, lambda m: all(int(x) <= 255 for x in m.split("."))), ("card", card, luhn), ("phone", phone, lambda m: 9 <= sum(c.isdigit() for c in m) <= 15)]
    for i, t in texts.items():
        base, counts = [], []
        for kind, pattern, ok in tests:
            own = [m.span() for m in pattern.finditer(t or "") if ok(m[0])]
            counts.append(len(own))
            base += [f"{kind}:{a}:{b}" for a, b in own]
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, i
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.spans.startswith(",".join(base))


def test_disclosing_terms(spark):
    rng = random.Random(3)
    common = ["the", "and", "said", "to", "with", "call"]
    rows = []
    for k in range(400):
        rows.append(" ".join(rng.choice(common) for _ in range(20)))
    for k in range(6):
        rows.append(f"zorblat said to call {rng.choice(common)} number {k} at zed@site.org and the rest")
    frame = spark.createDataFrame(list(enumerate([*rows, None])), "doc_id long, text string")
    hits = {r.term: r for r in pii.disclosing_terms(frame, bits=5.0).collect()}
    h = kernel.words(np.frombuffer(b"zorblat", np.uint8), np.array([0, 7]), kernel.ALNUM)[0]
    hit = hits[int(h.view(np.int64)[0])]
    assert hit.near == 6 and hit.uses == 6 and hit.share == 1.0
    common = kernel.words(np.frombuffer(b"said", np.uint8), np.array([0, 4]), kernel.ALNUM)[0]
    assert int(common.view(np.int64)[0]) not in hits
    assert pii.disclosing_terms(frame).count() == 0  # so small a corpus cannot hold ten bits
    spans = by_id(pii.report(frame, bits=5.0))
    assert "term:0:7" in spans[400].spans.split(",") and spans[0].spans == "" and spans[406].spans == ""
    clean = by_id(pii.sanitise(frame, bits=5.0))
    assert clean[400].text.startswith("[TERM] said to call") and "[EMAIL]" in clean[400].text and clean[0].text == rows[0]
    assert pii.report(frame.limit(0)).count() == 0


def test_terms_of_frequent_entities_and_small_corpora(spark):
    """One address in every third row, too few words for ten bits: its own term is found all the same, words seen everywhere are not."""
    rng = random.Random(4)
    common = ["the", "and", "said", "to", "with", "call"]
    some = lambda k: " ".join(rng.choice(common) for _ in range(k))
    rows = [f"{some(20)} zorblat {k} zed@site.org" if k % 3 == 0 else some(20) for k in range(60)]
    spans = by_id(pii.report(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    for k, text in enumerate(rows):
        at = text.find("zorblat")
        assert [x for x in spans[k].spans.split(",") if x.startswith("term")] == ([f"term:{at}:{at + 7}"] if at >= 0 else []), k


def test_terms_seen_twice_or_on_copied_lines(spark):
    """Two of two uses decide, on two lines or on copies of one; one use does not, even between two mentions, nor two of five."""
    filler = ["the and said to with call " * 5] * 200
    rows = ["quondam met ann@site.org", "then quondam wrote ann@site.org", *["vellum bob@site.org"] * 2]
    rows += ["cid@site.org oblong cid@site.org", "gadget dan@site.org", "old gadget dan@site.org", *["gadget"] * 3]
    spans = by_id(pii.report(spark.createDataFrame(list(enumerate(rows + filler)), "doc_id long, text string")))
    terms = {rows[k][int(a) : int(b)] for k in range(len(rows)) for kind, a, b in (x.split(":") for x in spans[k].spans.split(",") if x) if kind == "term"}
    assert terms == {"quondam", "vellum"}
    assert all(spans[k].spans == "" for k in range(len(rows), len(rows + filler)))


def test_boilerplate_lines(docs, texts):
    own = {r.doc_id: (r.text, r.source or "") for r in docs.select("doc_id", "text", "source").collect()}
    sites = defaultdict(set)
    for t, s in own.values():
        for line in (t or "").split("\n"):
            if SPACED.search(line):
                sites[line].add(s)
    for least in (2, 3):
        got = by_id(line_dedup.report(docs, least))
        for i, (t, _) in own.items():
            lines = (t or "").split("\n")
            kept = [x for x in lines if not (SPACED.search(x) and len(sites[x]) >= least)]
            r = got[i]
            assert (r.n_lines, r.n_removed) == (sum(bool(SPACED.search(x)) for x in lines), len(lines) - len(kept)), i
            assert r.text_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest(), i
    assert line_dedup.report(docs.limit(0)).count() == 0


def test_encoding_by_word_equals_encoding_whole_texts():
    import random

    from textloom.llm.queries import TOKENIZER
    from textloom.llm.token_files import Encoder

    by_word, whole, draw = Encoder(TOKENIZER(), True), Encoder(TOKENIZER(), False), random.Random(1)
    letters = "abszßéüŉªºAZÀİ'<|>.,!?%_-()[]{}\"#*&+/:;=@\\^`~$019́东 \n\t\x1c"
    texts = ["", "<|endoftext|>. Foo. don't x's. a..b c... straße! straße", *("".join(draw.choices(letters, k=draw.randint(0, 40))) for _ in range(4000))]
    for k in range(0, len(texts), 500):
        assert by_word.encode(texts[k : k + 500]) == whole.encode(texts[k : k + 500])


def test_secrets_and_terms_of_kinds(spark):
    """Keys are found by what their characters carry; a word that only stands near addresses, whosever they are, is a term, and so are two words together."""
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    filler = ["the and said to with call mail hold box " * 5] * 300
    rows = [f'ü token = "{key}" ö', "internationalisation-organisation 11111111111111111111a aaaa1111aaaa1111aaaa1111", f"{key}@example.org"]
    rows += [f"the zorb u{k}@s{k}.org said and with" for k in range(4)] + [f"call mail hold é v{k}@t{k}.org {k}" for k in range(4)]
    spans = by_id(pii.report(spark.createDataFrame(list(enumerate(rows + filler)), "doc_id long, text string")))
    at = rows[0].index(key)
    assert spans[0].spans == f"secret:{at}:{at + 40}" and spans[0].n_secret == 1 and spans[0].n_spans == 1
    assert spans[1].spans == "" and spans[2].spans.startswith("email:0:52") and spans[2].n_secret == 0
    for k in range(4):
        assert "term:4:8" in spans[3 + k].spans.split(",") and "zorb" == rows[3 + k][4:8]
        assert spans[7 + k].n_term == 1 and spans[7 + k].spans.endswith("term:15:16")
    assert all(spans[i].spans == "" for i in range(len(rows), len(rows) + len(filler)))


def test_long_texts_cost_in_proportion():
    """A text beyond the piece size is cut between words; hashes are the same as in one go."""
    text = ("wörd " * 1000 + "x" * 300 + "\n") * 600
    data, off = kernel.text_bytes(__import__("pyarrow").array(["short one", text, None, "tail"]))
    h, start, end, w = kernel.words(data, off, kernel.NOT_SPACE)
    assert len(data) > 2 * kernel.PIECE and len(h) == 2 + 600 * 1001 + 1 and w.tolist() == [0, 2, 2 + 600 * 1001, 2 + 600 * 1001, len(h)]
    assert len(set(h[2:-1].tolist())) == 2 and data[start[-1] : end[-1]].tobytes() == b"tail"


def test_token_files_of_hot_and_null_ids(spark, tmp_path, monkeypatch):
    """A doc_id with a third of all rows, and as many rows without one: several ranges share them, in order, nothing lost."""
    monkeypatch.setattr(token_files, "RANGE_BYTES", 2_000)
    rows = [(i, f"text {i} some words") for i in range(1000)] + [(500, f"hot {i}") for i in range(1000)] + [(None, f"none {i}") for i in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    manifest = token_files.write(frame, f"file://{tmp_path}/t", TOKENIZER(), by_word=True)
    assert manifest.select("range").distinct().count() > 6
    got = token_files.read_digests(manifest).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == 3000 and ids.count(None) == 1000 and ids.count(500) == 1001
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_access_unpacks_a_block_a_plane():
    a = np.random.default_rng(1).integers(0, 40_000, 3_000_000).astype(np.uint16)
    f = token_files.WaveletFile(token_files.WaveletFile.encode(a, [1], np.array([len(a)]), 2))
    assert f.access(2_999_999) == a[-1] and f.unpacked == f.planes and f._per_plane > 5
    assert f.rank(7, 1_500_000) == (a[:1_500_000] == 7).sum() and f.unpacked <= 4 * f.planes


def test_a_shingle_of_many_documents_goes_out_once(spark, monkeypatch):
    """Texts that share a passage, more of them in a block than are sent one by one."""
    from textloom.llm.ngram_join import OFTEN

    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(i, f"{passage} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))) for i in range(3 * OFTEN)]
    rows += [(10_000 + i, rows[i][1] + " tail") for i in range(40)] + [(20_000, passage), (20_001, passage + " more")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert {i: c for i, (_, c) in got.items()} == {i: i for i in range(3 * OFTEN)} | {10_000 + i: i for i in range(40)} | {20_000: 20_000, 20_001: 20_000}
    assert got[0][0] == 28 and got[20_000][0] == 8
