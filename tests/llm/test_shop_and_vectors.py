"""The leaderboard feed, vector codes and the quality model against brute force, SQL and held-out labels."""

import datetime
import hashlib
import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.llm import leaderboard, quality_model, vector_codes
from textloom.llm.queries import oracle_sql, queries


def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(v):
    return None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False)) if not frame.isna().any().any() else sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


# Leaderboard


def brute_feed(lines, items, vendors, batches, top=10, grace=3):
    """The contract, line by line, with boards sorted anew after each day."""
    price, nation = {}, {}
    for i in items:
        if i["item_id"] is not None:
            price.setdefault(i["item_id"], None)
            if i["price"] is not None:
                price[i["item_id"]] = max(i["price"], price[i["item_id"]] or i["price"])
    for v in vendors:
        if v["vendor_id"] is not None and v["nation_id"] is not None:
            nation[v["vendor_id"]] = min(v["nation_id"], nation.get(v["vendor_id"], v["nation_id"]))
    floor = lambda x: int(np.floor(100.0 * x + 0.5))
    fed = []
    for x in lines:
        text = ",".join("" if x[c] is None else str(x[c]) for c in ("sale_id", "item_id", "vendor_id", "line_no"))
        h = zlib.crc32(text.encode())
        s = 19723 + h % 150 if x["shipped_at"] is None else (x["shipped_at"].date() - datetime.date(1970, 1, 1)).days
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        cents = floor(x["amount"]) if x["amount"] is not None else 0 if x["quantity"] is None or price.get(x["item_id"]) is None else x["quantity"] * floor(price[x["item_id"]])
        fed.append((max(1, min(batches, 1 + (a - 19723) * batches // 180)), s, a, nation.get(x["vendor_id"]), x["item_id"] if x["item_id"] in price else None, -cents if x["flag"] == "returned" else cents))
    revenue, ranks, out, high = defaultdict(lambda: defaultdict(int)), defaultdict(dict), [], None
    for b in range(1, batches + 1):
        own = [x for x in fed if x[0] == b]
        for day in sorted({x[2] for x in own}):
            touched = set()
            for _, s, a, n, i, c in own:
                if a == day and n is not None and i is not None and (high is None or s + grace >= high):
                    revenue[n][i] += c
                    touched.add(n)
            for n in touched:
                best = sorted((-r, i) for i, r in revenue[n].items() if r > 0)[:top]
                now = {i: k + 1 for k, (_, i) in enumerate(best)}
                for i in now.keys() | ranks[n].keys():
                    old, new = ranks[n].get(i), now.get(i)
                    if old != new:
                        out.append((n, day, i, b, "enter" if old is None else "exit" if new is None else "move", old, new, revenue[n][i]))
                ranks[n] = now
        high = max([high or 0, *[x[1] for x in own]]) if own else high
    return out


FEED = ["nation_id", "arrival_day", "item_id", "batch", "change", "old_rank", "new_rank", "revenue"]


@pytest.fixture(scope="module")
def shop(spark):
    """Lines with one nation, item and vendor in a third of all, ties, returns, repeats, nulls, unknown items and vendors, and columns of clashing names."""
    rng = random.Random(12)
    day = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=int(150 * rng.random()), hours=rng.randint(0, 23))
    lines = []
    for k in range(2500):
        hot = rng.random() < 0.34
        lines.append({"sale_id": rng.choice([k, None]), "line_no": rng.choice([1, 2, None]), "item_id": 0 if hot else rng.choice([*range(60), None, 999]), "vendor_id": 0 if hot else rng.choice([*range(12), None, 777]), "quantity": rng.choice([1, 2, 3, None]), "amount": rng.choice([1.0, 2.5, 10.005, None, 0.0]), "flag": rng.choice(["kept", "returned", None]), "shipped_at": rng.choice([day(), day(), day(), None])})
    lines += rng.sample(lines, 60)
    items = [{"item_id": i, "price": rng.choice([1.115, 3.0, None])} for i in range(60)] + [{"item_id": 5, "price": 9.0}, {"item_id": None, "price": 1.0}]
    vendors = [{"vendor_id": v, "nation_id": rng.choice([0, 0, 1, 2, None])} for v in range(12)] + [{"vendor_id": 3, "nation_id": 2}, {"vendor_id": None, "nation_id": 1}]
    vendors[0]["nation_id"] = 0
    frames = (
        spark.createDataFrame(lines, "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp_ntz").withColumns({"price": F.lit(7.0), "batch": F.lit(3), "known_item": F.lit("x")}),
        spark.createDataFrame(items, "item_id long, price double").withColumn("vendor_id", F.lit(1)),
        spark.createDataFrame(vendors, "vendor_id long, nation_id int").withColumn("amount", F.lit(1)),
    )
    return frames, (lines, items, vendors)


def test_feed_of_awkward_lines(spark, shop):
    frames, plain_rows = shop
    got = leaderboard.change_feed(spark, *frames, batches=3)
    assert got.columns == FEED
    want = brute_feed(*plain_rows, batches=3)
    assert len(want) > 200 and {x[4] for x in want} == {"enter", "exit", "move"}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_feed_of_empty_tables(spark, shop):
    (lines, items, vendors), _ = shop
    assert leaderboard.change_feed(spark, lines.limit(0), items, vendors, batches=2).collect() == []


def test_late_lines_are_dropped_before_the_sums(shop):
    _, (lines, items, vendors) = shop
    assert brute_feed(lines, items, vendors, 10, grace=3) != brute_feed(lines, items, vendors, 10, grace=400)


def test_ranking_is_the_sorted_board():
    rng = random.Random(3)
    ranking, revenue = leaderboard.Ranking(np.array([7, 8, 9]), np.array([5, 5, -2])), {7: 5, 8: 5, 9: -2}
    for _ in range(3000):
        item = rng.randint(0, 40)
        revenue[item] = rng.randint(-3, 12)
        ranking.put(item, revenue[item])
        assert ranking.order == sorted((-r, i) for i, r in revenue.items() if r > 0)


class State:
    def __init__(self):
        self.held = {}

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return Value()

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key] = value


class Value:
    held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def test_shards_and_replay_equal_one_board():
    """Random sums by day, dealt to shards in three batches, with few revenues so that ties and returns change boards."""
    rng = random.Random(8)
    for shards in (1, 2, 7):
        made, revenue, want, ranks = [], defaultdict(int), [], {}
        for day in range(1, 40):
            for item in rng.sample(range(80), rng.randint(0, 12)):
                made.append((day, item, rng.randint(-4, 5)))
        for day in range(1, 40):
            for _, item, c in (x for x in made if x[0] == day):
                revenue[item] += c
            now = {i: k + 1 for k, (_, i) in enumerate(sorted((-r, i) for i, r in revenue.items() if r > 0)[:10])}
            want += [(day, i, ranks.get(i), now.get(i), revenue[i]) for i in now.keys() | ranks.keys() if ranks.get(i) != now.get(i)]
            ranks = now
        states, news = [leaderboard.Shard(10) for _ in range(shards)], []
        for s in states:
            s.init(State())
        for days in (range(1, 14), range(14, 15), range(15, 40)):
            for k, s in enumerate(states):
                part = pd.DataFrame([x for x in made if x[0] in days and x[1] % shards == k], columns=["day", "item_id", "cents"])
                if len(part):
                    halves = [part.sample(frac=1, random_state=k)[i::2] for i in range(2)]
                    news += list(s.handleInputRows((4, k), iter([h for h in halves if len(h)]), None))
        got = leaderboard.replay(pd.concat(news))
        assert set(got["nation_id"]) == {4}
        assert sorted(((r.arrival_day, r.item_id, plain(r.old_rank), plain(r.new_rank), r.revenue) for r in got.itertuples()), key=str) == sorted(want, key=str)


# Vector codes


def brute_codes(vectors, parts=8, entries=16, rounds=6, scale=4096):
    """``[(vec_id, components, label)]`` in order -> codes, errors and codebooks, each round from its assignments alone."""
    ints = [[int(np.floor(np.float64(x) * scale)) for x in v] for _, v, _ in vectors]
    width = len(ints[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in ints]
    books = [[cut[e][p] for e in range(min(entries, len(cut)))] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (dist(x, books[p][e]), e))
    for _ in range(rounds):
        codes = [[near(p, v[p]) for p in range(parts)] for v in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, c in zip(cut, codes) if c[p] == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own))
    codes = [[near(p, v[p]) for p in range(parts)] for v in cut]
    return codes, [sum(dist(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(cut, codes)], books


@pytest.mark.parametrize("bucket_rows", [250_000, 40])
def test_vector_codes_of_awkward_rows(spark, bucket_rows):
    rng = np.random.default_rng(4)
    good = [(i, [float(x) for x in rng.normal(0, 1, 16).round(1)], rng.choice([1, 2, None])) for i in range(300, 0, -1)]
    good += [(400, good[5][1], 1)] * 90 + [(7, good[9][1], None), (None, good[3][1], 2)]
    broken = [(0, None, 1), (-1, [1.0, None] * 8, 1), (-2, [float("nan")] * 16, 1), (-3, [1.0] * 15 + [float("inf")], 2), (-4, [], 1), (500, [1.0] * 8, 1), (501, [1e9] * 16, 1)]
    rows_ = [(i, v, None if lab is None else int(lab)) for i, v, lab in good + broken]
    frame = spark.createDataFrame(rows_, "vec_id long, embedding array<float>, label int").withColumns({"key": F.lit(1), "codes": F.lit("x"), "v": F.lit(2), "moved": F.lit(True)})
    got = vector_codes.report(frame, bucket_rows=bucket_rows).collect()
    kept = sorted([(i, [np.float32(x) for x in v], lab) for i, v, lab in rows_ if (i, v, lab) not in [tuple(b) for b in broken]], key=lambda r: (r[0] is None, r[0] or 0, [int(np.floor(np.float64(x) * 4096)) for x in r[1]]))
    codes, errors, books = brute_codes(kept)
    by_label = defaultdict(int)
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] += e
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    want = [(i, "".join(f"{c:02x}" for c in code), e, by_label[lab], digest) for (i, _, lab), code, e in zip(kept, codes, errors)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_vector_codes_of_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.report(spark.createDataFrame([], schema)).collect() == []
    got = vector_codes.report(spark.createDataFrame([(3, [0.5] * 8, None), (2, [0.25] * 8, None)], schema)).orderBy("vec_id").collect()
    assert [(r.vec_id, r.code, r.error) for r in got] == [(2, "00" * 8, 0), (3, "01" * 8, 0)]
    with pytest.raises(ValueError, match="cannot be cut"):
        vector_codes.encode(spark.createDataFrame([(1, [1.0] * 9, 1)], schema))


def test_vector_rounds_join_without_a_shuffle(spark, sf_dir):
    """Vectors and codes of one bucketing: the plan of a round has no exchange below its Python step."""
    kept = vector_codes.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("key", F.monotonically_increasing_id())
    buckets = vector_codes._Buckets(spark, 3)
    a, b = buckets.write(kept.repartition(3, "key")), buckets.write(kept.select("key", F.lit(b"x").alias("codes"), F.lit(False).alias("moved")), "moved")
    joined = a.select("key", "v").join(b.where("not moved").select("key", "codes").hint("shuffle_hash"), "key")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    buckets.drop(a)
    buckets.drop(b)


@pytest.mark.parametrize("name", ["op13_vector_codes"])
def test_against_sql(spark, sf_dir, name):
    got, want = queries()[name](spark, sf_dir).toPandas(), duck(sf_dir).execute(oracle_sql()[name]).fetchdf()
    assert len(got) and rows(got) == rows(want)


# Quality model


def brute_margin(m, index, value):
    """All pairs, one by one."""
    y = float(m.bias[0]) + sum(float(m.linear[i]) * x for i, x in zip(index, value))
    for a in range(len(index)):
        for b in range(a + 1, len(index)):
            y += float(np.dot(m.pairs[index[a]].astype(float), m.pairs[index[b]].astype(float))) * value[a] * value[b]
    return y


def test_linear_time_identity():
    rng = np.random.default_rng(1)
    m = quality_model.Machine()
    m.bias[:], m.linear[:], m.pairs[:] = 0.3, rng.normal(0, 1, m.linear.shape), rng.normal(0, 0.5, m.pairs.shape)
    first = np.array([0, 7, 8])
    index, value = rng.integers(0, quality_model.FEATURES, 20), rng.random(20).astype(np.float32)
    got, _ = m.margins(first, index, value)
    for k, (a, b) in enumerate([(0, 7), (7, 8), (8, 20)]):
        assert got[k] == pytest.approx(brute_margin(m, index[a:b], value[a:b].astype(float)), abs=1e-3)


def test_gradient_steps_lower_the_loss():
    rng = np.random.default_rng(2)
    first, index = np.arange(0, 600, 3), rng.integers(0, 40, 600)
    value = np.ones(600, np.float32)
    good = (np.bitwise_xor.reduce(index.reshape(-1, 3) & 1, axis=1)).astype(int)
    m = quality_model.Machine()
    loss = lambda: float(np.mean(np.logaddexp(0, np.where(good > 0, -1, 1) * m.margins(first, index, value)[0])))
    before = loss()
    m.fit(first, index, value, good, 60, np.random.default_rng(3))
    assert loss() < 0.6 * before


def test_quality_of_awkward_texts(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (3, None), (10_000_003, 0), (10_000_003, 1)], "doc_id long, quality int"))
    got = quality_model.classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    for r in got.collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert {r.predicted for r in quality_model.classify(docs, labels.limit(0)).collect()} == {1}
    assert quality_model.classify(docs.limit(0), labels).count() == 0


def test_held_out_labels_and_foreign_columns_do_not_matter(spark, docs):
    """Held-out labels, lang, source and the value of an id are no inputs: turning them round changes no score."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    turned = labels.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.reverse("source"), "good": F.lit(0), "score": F.lit(0.0)})
    score = lambda d, x: {r.doc_id: r.score for r in quality_model.classify(d, x).collect()}
    assert score(docs, labels) == score(other, turned)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.classify(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert len(bad) >= 5 and (good.predicted == 1).mean() > 0.95 and (bad.predicted == 0).mean() > 0.8
    auc = np.mean([(x > y) + 0.5 * (x == y) for x in good.score for y in bad.score])
    assert auc > 0.97
