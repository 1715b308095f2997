"""Change feed of a nation's best-selling items, from batches of sale lines through a stateful stream.

Each batch starts a Structured Streaming query anew on one checkpoint. ``transformWithStateInPandas`` keeps, for each nation and shard of its
items, the running revenues in a MapState and the board that was last told of. A batch's arrival days are replayed in order on a list
kept sorted by (-revenue, item_id) with bisect, and the boards before and after each day are compared. A nation with a third of all
lines is ``SHARDS`` groups of state: an item belongs to one shard, so a nation's board can only hold what is on the boards of its shards. The shards
tell what changed on theirs, at most twice ``TOP`` entries a day however many lines there were, and the same replay over those entries
gives the nation's board and its changes. Lines of an item on one day are added up before they are shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .runtime import fresh_path, make_path, materialize, move, releasing

if TYPE_CHECKING:  # the driver of other queries does without it
    import pandas as pd

TOP = 10
BATCHES = 10
#: Days by which a line may lie behind the latest day of the batches before its own.
GRACE = 3
#: Shards of a nation's items, at least; more for more items, so that a shard's list stays short.
SHARDS = 64
SHARD_ITEMS = 8192
#: Sums held by a task before they are sent on.
HELD_SUMS = 500_000

#: The first arrival day (2024-01-01 in days since 1970) and the days that the batches divide.
FIRST_DAY, DAYS = 19723, 180
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The store that transformWithState needs. A query ends with its batch, so executors close its stores with their tasks and hold nothing of them.
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": _ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
_LINES = "s int, day int, nation_id int, item_id long, cents long"
_SUMS = "nation_id int, shard int, day int, item_id long, cents long"
_NEWS = "nation_id int, shard int, day array<int>, item_id array<long>, revenue array<long>, on_board array<boolean>"
_FEED = "nation_id int, arrival_day long, item_id long, change string, old_rank int, new_rank int, revenue long"


class Ranking:
    """Revenues by item, and the items of positive revenue in the order of the board."""

    def __init__(self, items: np.ndarray, revenues: np.ndarray):
        self.revenue = dict(zip(items.tolist(), revenues.tolist()))
        up = np.flatnonzero(revenues > 0)
        up = up[np.lexsort((items[up], -revenues[up]))]
        self.order = list(zip((-revenues[up]).tolist(), items[up].tolist()))

    def put(self, item: int, revenue: int) -> None:
        old = self.revenue.get(item, 0)
        if old > 0:
            del self.order[bisect_left(self.order, (-old, item))]
        self.revenue[item] = revenue
        if revenue > 0:
            insort(self.order, (-revenue, item))

    def board(self, top: int) -> dict[int, int]:
        """Item -> revenue, best first."""
        return {item: -r for r, item in self.order[:top]}


def _by_day(days: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(day, from, to) of sorted days."""
    at = np.flatnonzero(np.diff(days, prepend=days[:1] - 1)) if len(days) else np.zeros(0, int)
    yield from zip(days[at].tolist(), at.tolist(), [*at[1:].tolist(), len(days)])


class Shard(StatefulProcessor):
    """State of one nation's shard of items: revenues in blocks (block -> packed items and cents) and the board last told of."""

    def __init__(self, top: int, blocks: int = 4):
        self.top, self.blocks = top, blocks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revenues = handle.getMapState("revenues", "block int", "items binary, cents binary")
        self.saved = handle.getValueState("board", "items binary, cents binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import pandas as pd

        parts = [[p[c].to_numpy(np.int64) for c in ("day", "item_id", "cents")] for p in rows]
        days, items, cents = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((items, days))
        days, items, cents = days[order], items[order], cents[order]
        first = np.flatnonzero((np.diff(days, prepend=days[0] - 1) != 0) | (np.diff(items, prepend=items[0] - 1) != 0))
        days, items, cents = days[first], items[first], np.add.reduceat(cents, first)

        held: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
        if (saved := self.saved.get()) is not None:  # a shard that has told of a board before has revenues
            held += [np.stack([np.frombuffer(x, np.int64) for x in v]) for b in range(self.blocks) if (v := self.revenues.getValue((b,))) is not None]
        ranking = Ranking(*np.concatenate(held, axis=1))
        before = dict(zip(*(np.frombuffer(x, np.int64).tolist() for x in saved))) if saved is not None else {}
        items_, cents_, news = items.tolist(), cents.tolist(), []
        for day, a, b in _by_day(days):
            for item, more in zip(items_[a:b], cents_[a:b]):
                ranking.put(item, ranking.revenue.get(item, 0) + more)
            board = ranking.board(self.top)
            news += [(day, i, r, True) for i, r in board.items() if before.get(i) != r]
            news += [(day, i, ranking.revenue[i], False) for i in before if i not in board]
            before = board

        ids = np.fromiter(ranking.revenue.keys(), np.int64, len(ranking.revenue))
        sums = np.fromiter(ranking.revenue.values(), np.int64, len(ranking.revenue))
        block, touched = ids % self.blocks, set((items % self.blocks).tolist())
        for b in touched:
            self.revenues.updateValue((b,), (ids[block == b].tobytes(), sums[block == b].tobytes()))
        self.saved.update(tuple(np.fromiter(x, np.int64, len(before)).tobytes() for x in (before.keys(), before.values())))
        if news:
            yield pd.DataFrame({"nation_id": [key[0]], "shard": [key[1]]} | {c: [list(x)] for c, x in zip(("day", "item_id", "revenue", "on_board"), zip(*news))})

    def close(self) -> None:
        pass


def replay(news: pd.DataFrame, top: int = TOP) -> pd.DataFrame:
    """A nation's feed from the news of its shards: the board's changes, day by day, from an empty board on."""
    import pandas as pd

    nation = int(news["nation_id"].iloc[0])
    days, items, revenues, on = (np.concatenate([np.asarray(x) for x in news[c]]) for c in ("day", "item_id", "revenue", "on_board"))
    order = np.argsort(days, kind="stable")
    days, rows = days[order], list(zip(items[order].tolist(), revenues[order].tolist(), on[order].tolist()))
    ranking, ranks, out = Ranking(np.zeros(0, np.int64), np.zeros(0, np.int64)), {}, []
    for day, a, b in _by_day(days):
        left = {}
        for item, revenue, on_board in rows[a:b]:
            ranking.put(item, revenue if on_board else 0)
            if not on_board:
                left[item] = revenue
        now = {item: k + 1 for k, item in enumerate(ranking.board(top))}
        for item in now.keys() | ranks.keys():
            old, new = ranks.get(item), now.get(item)
            if old != new:
                change = "enter" if old is None else "exit" if new is None else "move"
                out.append((nation, day, item, change, old, new, left.get(item, ranking.revenue[item])))
        ranks = now
    frame = pd.DataFrame(out, columns=["nation_id", "arrival_day", "item_id", "change", "old_rank", "new_rank", "revenue"])
    return frame.astype({"old_rank": "Int32", "new_rank": "Int32"})


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by nation, item and day of what a task reads, a bounded number held at a time."""
    keys, held = ["nation_id", "shard", "day", "item_id"], None
    for batch in batches:
        more = pa.Table.from_batches([batch])
        more = (more if held is None else pa.concat_tables([held, more])).group_by(keys).aggregate([("cents", "sum")])
        held = more.rename_columns([*keys, "cents"])
        if held.num_rows >= HELD_SUMS:
            yield from held.to_batches()
            held = None
    if held is not None:
        yield from held.to_batches()


def sale_lines_by_batch(lines: DataFrame, items: DataFrame, vendors: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``(s, day, nation_id, item_id, cents, batch)`` of every sale line: its day, arrival day, and what it adds to the revenue of an item in a nation.

    A line without a nation or an item of the items table has a null there. Non-finite amounts and prices count as null. Of several rows of one vendor
    the smallest nation_id holds, of one item the highest price. Arrival days before the first batch belong to it. Both joins are by sort and merge, so that AQE
    can split the lines of a common item or vendor; nothing is broadcast.
    """
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c).cast("double"))
    cents = lambda c: F.floor(F.lit(100.0) * c + F.lit(0.5))
    h = F.crc32(F.concat_ws(",", *[number(c) for c in ("sale_id", "item_id", "vendor_id", "line_no")]))
    rows = lines.select("item_id", "vendor_id", "quantity", finite("amount").alias("amount"), F.coalesce(F.col("flag") == "returned", F.lit(False)).alias("back"), F.unix_date(F.col("shipped_at").cast("date")).alias("s"), h.alias("h"))
    rows = rows.withColumn("s", F.coalesce("s", (FIRST_DAY + F.col("h") % 150).cast("int")))
    rows = rows.withColumn("day", (F.col("s") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)).cast("int")).drop("h")
    prices = materialize(items.where("item_id is not null").groupBy(F.col("item_id").alias("known_item")).agg(F.max(finite("price")).alias("price")), "prices")
    nations = materialize(vendors.where("vendor_id is not null").groupBy(F.col("vendor_id").alias("known_vendor")).agg(F.min("nation_id").cast("int").alias("nation_id")), "nations")
    rows = rows.join(prices.hint("merge"), F.col("item_id") == F.col("known_item"), "left")
    added = F.coalesce(cents(F.col("amount")), F.col("quantity").cast("double") * cents(F.col("price")), F.lit(0)).cast("long")
    rows = rows.select("s", "day", "vendor_id", F.col("known_item").alias("item_id"), F.when(F.col("back"), -added).otherwise(added).alias("cents"))
    rows = rows.join(nations.hint("merge"), F.col("vendor_id") == F.col("known_vendor"), "left")
    return rows.select("s", "day", "nation_id", "item_id", "cents", batch_of(F.col("day"), batches).alias("batch"))


def batch_of(day: Column, batches: int = BATCHES) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(batches), 1 + F.floor((day - FIRST_DAY) * batches / F.lit(DAYS)))).cast("int")


def shard_news(spark: SparkSession, lines: DataFrame, batches: int = BATCHES, top: int = TOP, grace: int = GRACE, shards: int = SHARDS) -> DataFrame:
    """Feed ``lines(s, day, nation_id, item_id, cents, batch)`` batch by batch to the stream: what changed on the shards' boards, as the query's sink has it.

    Lines that lie more than ``grace`` days behind the latest day ``s`` of the batches before their own are dropped, lines without a nation or an item ignored.
    All is written to a new folder of the shared storage at every call: the lines by batch, the checkpoint and the sink.
    """
    root = fresh_path(spark, "leaderboard")
    staged, fed, sink = f"{root}/staged", f"{root}/fed", f"{root}/news"
    lines.write.partitionBy("batch").option("compression", "zstd").parquet(staged)
    latest = {r["batch"]: r["s"] for r in spark.read.schema(f"{_LINES}, batch int").parquet(staged).groupBy("batch").agg(F.max("s").alias("s")).collect()}
    make_path(spark, fed)
    make_path(spark, sink)
    before = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        for batch in range(1, batches + 1):
            if batch in latest:
                move(spark, f"{staged}/batch={batch}", f"{fed}/batch={batch}")
                high = max([s for b, s in latest.items() if b < batch], default=latest[batch])
                _feed(spark, fed, f"{root}/checkpoint", sink, high - grace if min(latest) < batch else None, top, shards)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(_NEWS).parquet(sink)


def _feed(spark: SparkSession, source: str, checkpoint: str, sink: str, least: int | None, top: int, shards: int) -> None:
    """Start the query on what is new in ``source`` and wait for its end."""
    lines = spark.readStream.schema(_LINES).parquet(f"{source}/batch=*").where("nation_id is not null and item_id is not null")
    if least is not None:
        lines = lines.where(F.col("s") >= least)
    shard = F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int").alias("shard")
    sums = lines.select("nation_id", shard, "day", "item_id", "cents").mapInArrow(releasing(_combine), _SUMS)
    news = sums.groupBy("nation_id", "shard").transformWithStateInPandas(Shard(top), outputStructType=_NEWS, outputMode="Append", timeMode="None")
    query = news.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def change_feed(spark: SparkSession, sale_lines: DataFrame, items: DataFrame, vendors: DataFrame, batches: int = BATCHES, top: int = TOP, grace: int = GRACE) -> DataFrame:
    """``(nation_id, arrival_day, item_id, batch, change, old_rank, new_rank, revenue)``: a row for each item whose rank on its nation's board changed on a day.

    A board is the ``top`` highest positive revenues, ties to the smaller item_id. Repeated lines count each time; null days come from the line's hash; extra
    columns are not read. A day on which nothing changes gives no rows; empty tables give none.
    """
    n = items.select("item_id").count()
    shards = max(SHARDS, 1 << max(0, -(-n // SHARD_ITEMS) - 1).bit_length())
    lines = sale_lines_by_batch(sale_lines, items, vendors, batches)
    feed = shard_news(spark, lines, batches, top, grace, shards).groupBy("nation_id").applyInPandas(lambda news: replay(news, top), _FEED)
    return feed.select("nation_id", "arrival_day", "item_id", batch_of(F.col("arrival_day"), batches).alias("batch"), "change", "old_rank", "new_rank", "revenue")


#: CRC-32 from its polynomial, byte by byte, as the query's hash of a line.
ORACLE_SQL = f"""
WITH bits AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), hashed AS (
    SELECT l.*, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(concat(coalesce(sale_id::VARCHAR, ''), ',', coalesce(item_id::VARCHAR, ''), ',', coalesce(vendor_id::VARCHAR, ''), ',', coalesce(line_no::VARCHAR, '')), ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
    FROM sale_lines l, bits
), known AS (
    SELECT item_id, max(CASE WHEN isfinite(price) THEN price END) AS price FROM items WHERE item_id IS NOT NULL GROUP BY 1
), nations AS (
    SELECT vendor_id, min(nation_id) AS nation_id FROM vendors WHERE vendor_id IS NOT NULL GROUP BY 1
), dated AS (
    SELECT *, coalesce(shipped_at::DATE - DATE '1970-01-01', {FIRST_DAY} + h % 150) AS s FROM hashed
), placed AS (
    SELECT v.nation_id, i.item_id, s, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a,
        (CASE WHEN flag = 'returned' THEN -1 ELSE 1 END * coalesce(floor(100.0::DOUBLE * CASE WHEN isfinite(amount) THEN amount END + 0.5::DOUBLE), quantity::DOUBLE * floor(100.0::DOUBLE * price + 0.5::DOUBLE), 0))::BIGINT AS cents
    FROM dated d LEFT JOIN known i ON d.item_id = i.item_id LEFT JOIN nations v ON d.vendor_id = v.vendor_id
), batched AS (
    SELECT *, greatest(1, least({BATCHES}, 1 + floor((a - {FIRST_DAY}) * {BATCHES} / {DAYS}::DOUBLE)))::INT AS batch FROM placed
), high AS (
    SELECT b.batch, (SELECT max(s) FROM batched x WHERE x.batch < b.batch) AS high FROM (SELECT DISTINCT batch FROM batched) b
), sums AS (
    SELECT nation_id AS n, item_id AS i, a, sum(cents) AS cents FROM batched JOIN high USING (batch)
    WHERE nation_id IS NOT NULL AND item_id IS NOT NULL AND (high IS NULL OR s + {GRACE} >= high) GROUP BY 1, 2, 3
), running AS (
    SELECT n, i, a, sum(cents) OVER w AS revenue, lead(a) OVER w AS until FROM sums WINDOW w AS (PARTITION BY n, i ORDER BY a)
), days AS (
    SELECT n, a, row_number() OVER (PARTITION BY n ORDER BY a) AS k FROM (SELECT DISTINCT n, a FROM sums)
), stand AS (
    SELECT d.n, d.a, d.k, r.i, r.revenue FROM days d JOIN running r ON r.n = d.n AND r.a <= d.a AND (r.until IS NULL OR r.until > d.a)
), boards AS (
    SELECT n, k, i, rank FROM (SELECT *, row_number() OVER (PARTITION BY n, k ORDER BY revenue DESC, i) AS rank FROM stand WHERE revenue > 0) WHERE rank <= {TOP}
), changed AS (
    SELECT coalesce(x.n, y.n) AS n, coalesce(x.k, y.k + 1) AS k, coalesce(x.i, y.i) AS i, y.rank AS old_rank, x.rank AS new_rank
    FROM boards x FULL JOIN boards y ON x.n = y.n AND x.i = y.i AND x.k = y.k + 1
)
SELECT c.n::INT AS nation_id, s.a::BIGINT AS arrival_day, c.i AS item_id,
    greatest(1, least({BATCHES}, 1 + floor((s.a - {FIRST_DAY}) * {BATCHES} / {DAYS}::DOUBLE)))::INT AS batch,
    CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change,
    old_rank::INT AS old_rank, new_rank::INT AS new_rank, s.revenue::BIGINT AS revenue
FROM changed c JOIN stand s ON s.n = c.n AND s.k = c.k AND s.i = c.i WHERE old_rank IS DISTINCT FROM new_rank
"""
