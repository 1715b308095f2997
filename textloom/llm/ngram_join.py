"""N-gram Jaccard self-join with prefix trees, exact over whole texts.

1. One pass over the texts hashes each document's set of n-word shingles. Hashes go, packed by block of
   documents, to ranges of the hash space; a range counts each shingle's documents and gives the shingles of
   two or more a number that rises with that count. A shingle of one document can link nothing: it keeps its
   place in the set's size and is dropped. Numbers go back to the blocks, which hold each document's set in
   the global order, rarest first.
2. Two sets of Jaccard similarity t share one of the first n - ceil(t n) + 1 shingles of each (n of all, the
   single ones first). Only these are posted. Documents with fewer than t n shared shingles drop out here.
3. Links are found by walking prefix trees with a probe set: sets that begin alike share a path and the
   overlap counted along it, and a subtree is left when what remains of either side can't reach the overlap needed. First each set is
   tried against one pivot (smallest set id under a posted shingle), twice; then, for posted shingles whose
   sets still lie in different components, every such pair of sets meets in some tree, in bounded blocks that are walked with many
   probes at once. Pairs already connected are skipped: they cannot change the components.

Equal sets are one vertex throughout, so copies cost one row each. Shingles are told apart by 54 to 64 bits of hash (48, and those that
number the ranges, which follow the stored size): two documents of a thousand shingles see a false common one with a chance of 1e-10 at most.
A shingle that many documents of a block have goes to its range once for the block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .components import components
from .runtime import discard, look_up, materialize, releasing, tidy, unused, without_ids

#: Shingles packed together by a task, and shingles counted together, about; sets of one side in a tree.
BLOCK_SHINGLES = 300_000
RANGE_SHINGLES = 1_000_000
TREE_SETS = 300
#: Probes that walk a tree together: so many that a bit for each of the tree's tokens and probe takes so many bytes.
WALK_BYTES = 2_000_000
#: Documents of a block at most: their places take 16 bits beside 48 bits of a shingle's hash. A shingle of so many documents of a block, or more, goes
#: to its range once for the block, so that a shingle of a third of all documents does not crowd a range; places from ``BLOCK_DOCS`` on stand for those.
#: There are ``OFTEN_PLACES`` of them: beyond that the most frequent ones take them, the others go document by document.
BLOCK_DOCS = 60_000
OFTEN = 128
OFTEN_PLACES = (1 << 16) - BLOCK_DOCS
#: Shingles that a stored byte of documents gives, about, and the bits that a range takes at most: at 100 TB a range holds 30 million shingles.
SHINGLES_A_BYTE = 0.3
MOST_BITS = 20
#: A shingle's number: the class of its count, its range, its place in the range.
LEVEL_AT, RANGE_AT = 56, 34

_RANGED = "r int, blk long, meta boolean, nd int, a binary, b binary"
_SETS = "doc_id long, sig binary, n int, toks binary"


def pack(tokens: np.ndarray) -> bytes:
    """Rising longs as differences, byte plane by byte plane: mostly zero planes, which any codec squeezes."""
    d = np.diff(tokens, prepend=np.int64(0)).astype("<i8")
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<i8").ravel())


def _binary(flat: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Slices of an array, between the cuts, as binary values."""
    return pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer((cut * flat.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _flat(column: pa.ChunkedArray | pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All binary values of a column as one array of ``kind``, and where each begins."""
    column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    if column.buffers()[2] is None:
        return np.zeros(0, kind), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind), (off - off[0]) // np.dtype(kind).itemsize


def _hash_pass(n_words: int, bits: int):
    def flush(blk, ids, sets):
        sizes = np.array([len(s) for s in sets], np.int64)
        h = np.concatenate(sets)
        sets.clear()
        some, first = np.flatnonzero(sizes), (np.cumsum(sizes) - sizes)[sizes > 0]
        sig = np.zeros((len(ids), 2), np.uint64)
        if len(h):
            m = kernel.mix(h)
            sig[some, 0] = np.add.reduceat(m, first)
            sig[some, 1] = np.bitwise_xor.reduceat(kernel.mix(m + np.uint64(1)), first)
        place = np.repeat(np.arange(len(ids), dtype=np.uint64), sizes)
        coded = pa.array(h).dictionary_encode()
        of = coded.indices.to_numpy()
        count = np.bincount(of)
        often = np.flatnonzero(count >= OFTEN)
        if len(often) > OFTEN_PLACES:
            often = np.sort(often[np.argsort(-count[often], kind="stable")[:OFTEN_PLACES]])
        hot_docs, hot_cut = np.zeros(0, np.uint16), np.zeros(1, np.int32)
        if len(often):
            number = np.full(len(count), -1, np.int64)
            number[often] = np.arange(len(often))
            which = number[of]
            at = np.flatnonzero(which >= 0)
            at = at[np.argsort(which[at], kind="stable")]
            hot_docs, hot_cut = place[at].astype(np.uint16), np.concatenate(([0], np.cumsum(count[often]))).astype(np.int32)
            rest = which < 0
            h = np.concatenate((h[rest], coded.dictionary.to_numpy()[often]))
            place = np.concatenate((place[rest], np.arange(BLOCK_DOCS, BLOCK_DOCS + len(often), dtype=np.uint64)))
        # a word: 48 bits of the hash, and the document's place
        word = (h << np.uint64(bits)) & ~np.uint64(0xFFFF) | place
        r = (h >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        order = np.argsort(r, kind="stable")
        cut = np.searchsorted(r[order], np.arange(2**bits + 1))
        word = word[order]
        own = np.flatnonzero(np.diff(cut))
        here = int(kernel.mix(np.array([blk], np.uint64))[0] >> np.uint64(64 - bits))
        meta = _stream(pa.table({"id": pa.array([ids], pa.list_(pa.int64())), "n": pa.array([sizes.astype(np.int32)]), "docs": pa.array([hot_docs]), "cut": pa.array([hot_cut])}))
        names = _names(_RANGED)
        yield pa.record_batch([pa.array([here], pa.int32()), pa.array([blk]), pa.array([True]), pa.array([len(ids)], pa.int32()), pa.array([sig.tobytes()], pa.binary()), pa.array([meta], pa.binary())], names=names)
        for a in range(0, len(own), 256):
            k = own[a : a + 256]
            at = np.append(cut[k], cut[k[-1] + 1])
            n = len(k)
            yield pa.record_batch([pa.array(k, pa.int32()), pa.array(np.full(n, blk)), pa.array(np.zeros(n, bool)), pa.array(np.full(n, len(ids)), pa.int32()), _binary(word[at[0] : at[-1]], at - at[0]), pa.array([b""] * n, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blk, ids, sets, held = TaskContext.get().partitionId() << 32, [], [], 0
        most = max(BLOCK_SHINGLES, min(32 << bits, max(1 << 21, 8 << bits)))  # some shingles for each range, however many there are
        for batch in batches:
            own = batch.column("doc_id").to_pylist()
            for i, s in enumerate(kernel.shingle_sets(*kernel.text_bytes(batch.column("text")), n_words)):
                ids.append(own[i])
                sets.append(s)
                held += len(s)
                if held >= most or len(ids) >= BLOCK_DOCS:
                    yield from flush(blk, ids, sets)
                    blk, ids, sets, held = blk + 1, [], [], 0
        if ids:
            yield from flush(blk, ids, sets)

    return run


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _count_range(table: pa.Table) -> pa.Table:
    """Give the shingles of a range that two or more documents have their places in the global order: (class of counts, range, number)."""
    meta = table.filter(table["meta"])
    rows = table.filter(pc.invert(table["meta"]))
    word, off = _flat(rows["a"], np.uint64)
    token = np.full(len(word), -1, np.int64)
    r = int(table["r"][0].as_py())
    slices, told = max(0, (len(word) // (4 * RANGE_SHINGLES)).bit_length()), 0
    for part in range(1 << slices):  # a crowded range goes slice by slice of its hashes
        at = np.arange(len(word)) if not slices else np.flatnonzero(word >> np.uint64(64 - slices) == part)
        key = word[at] >> np.uint64(16)
        order = np.argsort(key)
        key = key[order]
        if not len(key):
            continue
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        runs = np.diff(np.append(first, len(key)))
        df = np.add.reduceat(np.where(word[at[order]] & np.uint64(0xFFFF) < BLOCK_DOCS, 1, OFTEN), first)
        shared = df > 1
        number = np.full(len(df), -1, np.int64)
        level = np.log2(df[shared]).astype(np.int64)
        number[shared] = level << LEVEL_AT | np.int64(r) << RANGE_AT | np.arange(told, told + len(level))
        told += len(level)
        token[at[order]] = np.repeat(number, runs)
    kept = token >= 0
    cut = np.concatenate(([0], np.cumsum(kept)))[off]
    some = np.flatnonzero(np.diff(cut))
    at = np.append(cut[some], cut[-1])
    out = rows.take(pa.array(some)).select(["r", "blk", "meta", "nd"])
    docs = (word[kept] & np.uint64(0xFFFF)).astype(np.uint16)
    out = out.append_column("a", _binary(docs, at)).append_column("b", _binary(token[kept], at))
    return pa.concat_tables([meta, out.cast(meta.schema)])


def _gather_block(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        head = table.filter(table["meta"]).to_pylist()[0]
        rows = table.filter(pc.invert(table["meta"]))
        nd = head["nd"]
        kept = pa.ipc.open_stream(head["b"]).read_all()
        own = {c: kept[c].combine_chunks().values for c in kept.column_names}
        sizes = own["n"].to_numpy().astype(np.int64)
        docs, toks = _flat(rows["a"], np.uint16)[0].astype(np.int64), _flat(rows["b"], np.int64)[0]
        if len(own["docs"]):
            hot, each = docs >= BLOCK_DOCS, own["cut"].to_numpy().astype(np.int64)
            k, often = docs[hot] - BLOCK_DOCS, toks[hot]
            size = each[k + 1] - each[k]
            to = np.cumsum(size)
            more = own["docs"].to_numpy()[np.repeat(each[k] - to + size, size) + np.arange(size.sum())]
            docs, toks = np.concatenate((docs[~hot], more.astype(np.int64))), np.concatenate((toks[~hot], np.repeat(often, size)))
        live = num * sizes <= den * np.bincount(docs, minlength=nd)
        live &= sizes > 0
        keep = live[docs]
        docs, toks = docs[keep], toks[keep]
        order = np.argsort(toks)
        order = order[np.argsort(docs[order], kind="stable")]
        docs, toks = docs[order], toks[order]
        cut = np.searchsorted(docs, np.arange(nd + 1))
        packed = [pack(toks[cut[i] : cut[i + 1]]) if live[i] else None for i in range(nd)]
        sigs = _binary(np.frombuffer(head["a"], np.uint8), np.arange(nd + 1) * 16)
        return pa.table({"doc_id": own["id"], "sig": sigs, "n": own["n"], "toks": pa.array(packed, pa.binary())})

    return run


def ordered_sets(docs: DataFrame, n_words: int = 5, threshold: tuple[int, int] = (4, 5), bits: int | None = None) -> DataFrame:
    """``(doc_id, sig, n, toks)``, a row per document: the set's signature and size, and its shared shingles in the
    global order, or null where too few are shared for any link to a different text or a copy. ``bits``: those that number
    the ranges, by default from the stored size."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if bits is None:
        stored = min(int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 1 << 50)
        bits = min(MOST_BITS, max(6, math.ceil(math.log2(max(1, SHINGLES_A_BYTE * stored / RANGE_SHINGLES)))))
    ranged = docs.mapInArrow(releasing(_hash_pass(n_words, bits)), _RANGED)
    numbered = ranged.groupBy("r").applyInArrow(_count_range, _RANGED)
    return numbered.groupBy("blk").applyInArrow(_gather_block(*threshold), _SETS)


class PrefixTree:
    """Sets (rising arrays of tokens) in a path-compressed trie.

    A node holds a run of tokens, its child nodes, the rows that end there, and over its subtree the least and
    greatest set size and the greatest number of tokens from the node's first one on.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sizes, self.known = sizes, np.unique(np.concatenate([np.zeros(0, np.int64), *sets]))
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.root = self._node(np.zeros(0, np.int64))
        path: list[tuple[int, dict]] = [(0, self.root)]  # depth at which a node's run ends
        last = np.zeros(0, np.int64)
        for i in order:
            s = sets[i]
            m = min(len(s), len(last))
            differ = np.flatnonzero(s[:m] != last[:m])
            common = int(differ[0]) if len(differ) else m
            below = None
            while path[-1][0] > common:
                below = path.pop()
            if path[-1][0] < common:  # split the run of the node below
                end, node = below
                cut = len(node["run"]) - (end - common)
                upper = self._node(node["run"][:cut])
                node["run"] = node["run"][cut:]
                upper["kids"].append(node)
                path[-1][1]["kids"][-1] = upper
                path.append((common, upper))
            if len(s) > common:
                leaf = self._node(s[common:])
                path[-1][1]["kids"].append(leaf)
                path.append((len(s), leaf))
            path[-1][1]["rows"].append(i)
            last = s
        self._close(sizes)

    @staticmethod
    def _node(run):
        return {"run": run, "kids": [], "rows": [], "least": 1 << 60, "most": 0, "rest": 0, "comp": -1}

    def _close(self, sizes):
        todo, out = [self.root], []
        while todo:
            out.append(node := todo.pop())
            todo += node["kids"]
        self._order = out
        for node in reversed(out):
            own = [sizes[i] for i in node["rows"]]
            node["least"] = min([*own, *(k["least"] for k in node["kids"])], default=0)
            node["most"] = max([*own, *(k["most"] for k in node["kids"])], default=0)
            node["rest"] = len(node["run"]) + max((k["rest"] for k in node["kids"]), default=0)

    def walk_all(self, probes: list[np.ndarray], sizes: list[int], num: int, den: int, links: Links, first: int = 0) -> None:
        """Walk with many probes at once: a node is visited with those that still may overlap enough. Links between different components go
        to ``links``, where probe i is number ``first + i``; pairs within one component are passed over."""
        known = self.known
        has = np.zeros((len(probes), len(known) + 1), bool)
        for i, p in enumerate(probes):
            at = np.searchsorted(known, p)
            at = at[at < len(known)] if len(p) else at
            has[i, at[known[at] == p[: len(at)]]] = True
        left = np.cumsum(has[:, ::-1], axis=1, dtype=np.int32)[:, ::-1]  # tokens of the tree that a probe has from each on
        size = np.array(sizes, np.int64)
        todo = [(self.root, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
        while todo:
            node, who, have = todo.pop()
            own = size[who]
            stay = (den * node["most"] >= num * own) & (num * node["least"] <= den * own)
            run = np.searchsorted(known, node["run"])
            if len(run):
                need = -(-num * (own + np.maximum(node["least"], -(-num * own // den))) // (num + den))
                stay &= have + np.minimum(node["rest"], left[who, run[0]]) >= need
            if node["comp"] >= 0:
                stay &= links.apart(first + who, node["comp"])
            if not stay.any():
                continue
            who, have = who[stay], have[stay]
            if len(run):
                have = have + np.count_nonzero(has[np.ix_(who, run)], axis=1)
            for i in node["rows"]:
                fits = who[(num + den) * have >= num * (size[who] + self.sizes[i])]
                for k in fits[links.apart(first + fits, links.built[i])].tolist():
                    links.join(first + k, i)
            todo += [(k, who, have) for k in node["kids"]]

    def mark(self, comp: np.ndarray) -> None:
        """Note in each node the component of all rows below it, or -1 if there are several."""
        for node in reversed(self._order):
            seen = {int(comp[i]) for i in node["rows"]} | {k["comp"] for k in node["kids"]}
            node["comp"] = seen.pop() if len(seen) == 1 else -1

    def walk(self, probe: np.ndarray, size: int, num: int, den: int, skip=None) -> Iterator[int]:
        """Rows whose Jaccard similarity with the probe (its shared tokens, its full size) is num/den at least.

        ``skip(row)``: rows not to report.
        """
        todo = [(self.root, 0)]
        while todo:
            node, have = todo.pop()
            if den * node["most"] < num * size or num * node["least"] > den * size:
                continue
            need = -(-num * (size + max(node["least"], -(-num * size // den))) // (num + den))
            run = node["run"]
            if len(run):
                at = int(np.searchsorted(probe, run[0]))
                if have + min(node["rest"], len(probe) - at) < need:
                    continue
                where = np.searchsorted(probe, run)
                where[where == len(probe)] = 0
                have += int(np.count_nonzero(probe[where] == run)) if len(probe) else 0
            for i in node["rows"]:
                if (num + den) * have >= num * (size + self.sizes[i]) and (skip is None or not skip(i)):
                    yield i
            todo += [(k, have) for k in node["kids"]]


def _groups(batches: Iterator[pa.RecordBatch], key: list[str], most: int | None = None) -> Iterator[list[dict]]:
    """Consecutive rows of equal key, at most ``most`` at a time."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (any(held[0][k] != row[k] for k in key) or most and len(held) >= most):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _links(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["u", "v"])


def _try_pivots(num: int, den: int):
    def run(batches):
        for rows in _groups(batches, ["pivot"], TREE_SETS):
            sizes = [r["n"] for r in rows]
            tree = PrefixTree([unpack(r["toks"]) for r in rows], sizes)
            found = [(rows[i]["sig"], rows[0]["pivot"]) for i in tree.walk(unpack(rows[0]["p_toks"]), rows[0]["p_n"], num, den)]
            if found:
                yield _links(found)

    return run


class Links:
    """Components met in a group, and the links found between them: ``label`` numbers each component's merged one."""

    def __init__(self, built: list[dict], asked: list[dict]):
        self._built, self._asked, number = built, asked, {}
        self.built, self.asked = (np.array([number.setdefault(r["comp"], len(number)) for r in side], np.int64) for side in (built, asked))
        self.label = np.arange(len(number))
        self.found: list[tuple[bytes, bytes]] = []

    def apart(self, probes: np.ndarray, comp: int) -> np.ndarray:
        return self.label[self.asked[probes]] != self.label[comp]

    def join(self, probe: int, row: int) -> None:
        a, b = self.label[self.asked[probe]], self.label[self.built[row]]
        if a != b:
            self.label[self.label == a] = b
            self.found.append((self._asked[probe]["sig"], self._built[row]["sig"]))


def _join_blocks(num: int, den: int):
    """Each group: two blocks of sets under one posted shingle (or one block twice). Links between components not yet joined."""

    def run(batches):
        for rows in _groups(batches, ["key", "i", "j"]):
            built = [r for r in rows if r["side"] == 0]
            asked = built if rows[0]["i"] == rows[0]["j"] else [r for r in rows if r["side"] == 1]
            links = Links(built, asked)
            tree = PrefixTree([unpack(r["toks"]) for r in built], [r["n"] for r in built])
            tree.mark(links.built)
            some = max(1, min(256, WALK_BYTES // (1 + len(tree.known))))
            for a in range(0, len(asked), some):
                part = asked[a : a + some]
                tree.walk_all([unpack(r["toks"]) for r in part], [r["n"] for r in part], num, den, links, a)
            if links.found:
                yield _links(links.found)

    return run


def similar_components(docs: DataFrame, n_words: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """``docs(doc_id integer, text)`` -> ``(doc_id, n_shingles, component_id)``, a row per input row.

    Documents are linked when the Jaccard similarity of their sets of ``n_words``-word shingles is
    ``threshold`` (numerator, denominator) at least; ``component_id`` is the smallest doc_id reachable.
    A text of fewer words is one shingle; null, empty and blank texts have none, link with nothing and keep
    their own id. Repeated rows link with each other. Rows with a null doc_id take part and are ignored in the
    smallest id (null if a component has no other). Extra columns are not read. An empty table gives no rows.
    """
    num, den = threshold
    tidy(docs.sparkSession)
    base = materialize(ordered_sets(docs, n_words, threshold), "sets")
    sets = materialize(base.where("toks is not null").groupBy("sig").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("toks").alias("toks")), "vertices")

    def post(batches):
        for batch in batches:
            keys, sigs = [], []
            for r in batch.to_pylist():
                t = unpack(r["toks"])
                k = r["n"] - -(-num * r["n"] // den) + 1 - (r["n"] - len(t))
                keys.append(t[:k])
                sigs += [r["sig"]] * min(k, len(t))
            yield pa.record_batch([pa.array(np.concatenate(keys) if keys else [], pa.int64()), pa.array(sigs, pa.binary())], names=["key", "sig"])

    posted = sets.select("sig", "n", "toks").mapInArrow(releasing(post), "key long, sig binary")
    several = posted.groupBy("key").agg(F.min("sig").alias("pivot"), F.count("*").alias("k")).where("k > 1").drop("k")
    posted = materialize(posted.join(several, "key"), "posted")

    def verified(tries: DataFrame) -> DataFrame:
        """Of ``tries(sig, pivot)`` each set's most frequent pivot."""
        best = tries.groupBy("sig", "pivot").count().groupBy("sig").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot"))
        held = best.join(sets.select("sig", "n", "toks"), "sig")
        probes = sets.select(F.col("sig").alias("pivot"), F.col("n").alias("p_n"), F.col("toks").alias("p_toks"))
        return held.join(probes, "pivot").sortWithinPartitions("pivot").mapInArrow(releasing(_try_pivots(num, den)), "u binary, v binary")

    passing: list[DataFrame] = []

    def labelled(roots: DataFrame) -> DataFrame:
        """Postings under shingles whose sets lie in several components."""
        own = posted.join(roots.withColumnRenamed("u", "sig"), "sig", "left").select("key", "sig", F.coalesce("v", "sig").alias("comp"))
        discard(*passing)
        passing[:] = [own := materialize(own, "labelled")]
        ends = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by("sig", F.struct("comp", "sig")).alias("p_lo"), F.max_by("sig", F.struct("comp", "sig")).alias("p_hi")).where("lo <> hi")
        return own.join(ends, "key")

    links = materialize(verified(posted.where("sig <> pivot").select("sig", "pivot")), "links")
    roots = components(links)
    tidy(docs.sparkSession)
    mixed = labelled(roots)
    more = verified(mixed.select("sig", F.when(F.col("comp") != F.col("lo"), F.col("p_lo")).otherwise(F.col("p_hi")).alias("pivot")))
    first, links = links, materialize(links.union(more), "links")
    roots = components(links)
    mixed = materialize(labelled(roots).select("key", "sig", "comp"), "mixed")
    tidy(docs.sparkSession)
    if not mixed.isEmpty():
        last, links = links, materialize(links.union(_exhaust(mixed, sets, num, den)), "links")
        discard(last)
        roots = components(links)
    discard(posted, first, links, mixed, *passing)
    tidy(docs.sparkSession)
    named = sets.select("sig", "low").join(roots.withColumnRenamed("u", "sig"), "sig", "left").select("sig", F.coalesce("v", "sig").alias("root"), "low")
    ids = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.select("sig", "root").join(ids, "root").select("sig", "component_id")
    base = base.select("doc_id", "sig", "n", F.col("toks").isNotNull().alias("live"))
    single = base.where("not live").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return base.where("live").join(named, "sig").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").union(single)


def _exhaust(mixed: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Every pair of sets of different components under a shared posted shingle meets in one task's tree.

    Under a key, sets of the most frequent component are the large side and the others the small one; each side
    is cut into blocks. A block of either side meets every block of the small side, so that the sets of the large
    component, which are connected already, are never compared with each other.
    """
    # shingles under which the same sets meet ask for the same comparisons: one of them is enough
    print_ = [F.bit_xor(F.xxhash64("sig", F.lit(k))).alias(f"x{k}") for k in range(2)]
    alike = mixed.groupBy("key").agg(*print_, F.count("*").alias("k")).groupBy("x0", "x1", "k").agg(F.min("key").alias("key"))
    mixed = materialize(mixed.join(alike.select("key"), "key", "left_semi"), "meeting")
    sizes = mixed.groupBy("key", "comp").count()
    top = sizes.groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("top"), F.max("count").alias("n_top"), F.sum("count").alias("n_all"))
    rows = mixed.join(top, "key").withColumn("large", F.col("comp") == F.col("top"))
    blocks = lambda n: F.ceil(n / F.lit(TREE_SETS)).cast("int")
    n_small, n_large = blocks(F.col("n_all") - F.col("n_top")), blocks(F.col("n_top"))
    own = F.pmod(F.xxhash64("sig"), F.when(F.col("large"), n_large).otherwise(n_small)).cast("int")
    rows = rows.withColumn("own", own)
    # tasks (i, j): i >= 0 is a block of the small side; j a block of it from i on, or -1 - j a block of the large side
    meets = F.when(
        F.col("large"), F.transform(F.sequence(F.lit(0), n_small - 1), lambda i: F.struct(i.alias("i"), (-1 - F.col("own")).alias("j"), F.lit(1).alias("side")))
    ).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), n_small - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"), F.when(k < F.col("own"), 1).otherwise(0).alias("side"))),
            F.transform(F.sequence(F.lit(0), n_large - 1), lambda k: F.struct(F.col("own").alias("i"), (-1 - k).alias("j"), F.lit(0).alias("side"))),
        )
    )
    rows = rows.select("key", "sig", "comp", F.explode(meets).alias("m")).select("key", "sig", "comp", "m.*")
    rows = rows.join(sets.select("sig", "n", "toks"), "sig")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return rows.mapInArrow(releasing(_join_blocks(num, den)), "u binary, v binary")


def keep_one(docs: DataFrame, n_words: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """Drop all but one document of each component, that of the smallest doc_id; columns as they come.

    Every row is a document of its own, also where several share a doc_id or have none: different texts all stay, of copies one. Among rows of one
    doc_id an arbitrary one comes first, rows without a doc_id come last.
    """
    ids = docs.groupBy("doc_id").count().agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull() | (F.col("count") > 1)).alias("odd")).first()
    if not ids["odd"]:
        found = materialize(similar_components(docs, n_words, threshold), "components")
        return without_ids(docs, found.where("doc_id <> component_id").select("doc_id"))
    # rows that an id does not name get one of their own, below all others, and are written, so that it stays theirs
    key, named = unused(docs, "row_key"), unused(docs, "same")
    shared = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias(named)), "shared")
    marked = look_up(docs, shared).withColumn(named, F.coalesce(named, F.col("doc_id").isNull()))
    odd = marked.where(named).withColumn(key, F.lit(min(0, ids["low"] or 0) - 1) - F.monotonically_increasing_id()).drop(named)
    odd = materialize(odd, "odd_rows")
    rows = marked.where(~F.col(named)).drop(named).withColumn(key, F.col("doc_id").cast("long")).unionByName(odd)
    found = materialize(similar_components(rows.select(F.col(key).alias("doc_id"), "text"), n_words, threshold), "components")
    real = look_up(found, odd.select(F.col(key).alias("doc_id"), F.col("doc_id").cast("long").alias("real"), F.lit(True).alias("odd")))
    first = F.struct(F.coalesce(F.when(F.col("odd"), F.col("real")).otherwise(F.col("doc_id")), F.lit((1 << 63) - 1)), "doc_id")
    kept = materialize(real.groupBy("component_id").agg(F.min_by("doc_id", first).alias("kept")), "kept")
    gone = found.join(kept.hint("shuffle_merge"), "component_id").where("doc_id <> kept").select(F.col("doc_id").alias("gone"))
    return without_ids(rows, gone, key).select(*docs.columns)
