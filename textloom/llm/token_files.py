"""Token-id output: one wavelet-matrix file for each shard of documents, in ascending doc_id order.

A shard's ids are stored as bit planes. Plane 0 holds the top bit of every id in order; each further plane holds
the next bit after a stable partition by the one before (zeros first). Beside each plane the file keeps the count of ones before every
512th bit, and planes are compressed in blocks of 64 KB, so ``access(i)``, ``rank(symbol, i)``, ``count(symbol, a, b)`` and
``select(symbol, k)`` read and unpack one or two blocks a plane, from the file alone.

Layout, little-endian: magic, version, planes, ids, documents, end id; zeros of each plane; sizes of the three document parts; sizes of
the compressed blocks of each plane; the document parts: doc_ids (int64), which of them are null (bits), lengths (uint32);
the counts of each plane (uint32); the blocks.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files, kernel
from .runtime import BROADCAST_BYTES, fresh_path, keep_warm, materialize, releasing, tidy

MAGIC = b"TLWM"
HEAD = struct.Struct("<4sHHQQI")
BLOCK = 512
BLOCK_BYTES = 1 << 16
#: Ids of a file, about; stored bytes of the documents of a range, about.
SHARD_TOKENS = 8_000_000
RANGE_BYTES = 128_000_000
#: Positions that are partitioned at a time, so that they stay in cache.
_STRIDE = 1 << 17
#: Words that a worker remembers (slots of a table, 16 bytes each) and their ids; words of more bytes are told apart by a hash of their own.
MEMO_SLOTS = 1 << 21
MEMO_IDS = 12_000_000
LONG_WORD = 256
_BEYOND_LATIN = re.compile("[İɐ-\U0010ffff]")
#: Lower-case Latin letters: many words of them lie side by side in one text for the model. Marks after a letter are words of their own.
_LETTERS = re.compile("[a-zß-öø-ɏ]+")
_MARKS = [*"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~", "...", ",%%%", "!!"]
_MARK = np.zeros(256, bool)
_MARK[[ord(m) for m in _MARKS if len(m) == 1]] = True
_TOGETHER = 200


class WaveletFile:
    """A shard's ids with rank and select support, from bytes or an open file of random access."""

    def __init__(self, data):
        self._file = pa.BufferReader(data) if isinstance(data, (bytes, memoryview)) else data
        magic, version, self.planes, self.n, self.n_docs, self.end_id = HEAD.unpack(self._read(0, HEAD.size))
        if magic != MAGIC or version != 2:
            raise ValueError("not a token file")
        self._per_plane, self._counts = -(-(-(-self.n // 8)) // BLOCK_BYTES), -(-self.n // BLOCK)
        at = HEAD.size
        self._zeros = self._array(at, self.planes, "<u8").astype(np.int64)
        at += 8 * self.planes
        parts = self._array(at, 3, "<u8").astype(np.int64)
        at += 24
        sizes = self._array(at, self.planes * self._per_plane, "<u4").astype(np.int64)
        at += 4 * len(sizes)
        self._parts = at + np.concatenate(([0], np.cumsum(parts)))
        self._ranks = int(self._parts[-1])
        self._blocks = self._ranks + 4 * self.planes * self._counts + np.concatenate(([0], np.cumsum(sizes)))
        self._before: dict[int, np.ndarray] = {}
        self._open: dict[int, np.ndarray] = {}
        #: Blocks unpacked so far.
        self.unpacked = 0

    def _read(self, at: int, n: int) -> bytes:
        return self._file.read_at(n, at)

    def _array(self, at: int, n: int, kind: str) -> np.ndarray:
        return np.frombuffer(self._read(at, n * np.dtype(kind).itemsize), kind)

    def _part(self, k: int, size: int) -> bytes:
        a, b = int(self._parts[k]), int(self._parts[k + 1])
        return pa.decompress(self._read(a, b - a), size, codec="zstd", asbytes=True) if size else b""

    @classmethod
    def encode(cls, ids: np.ndarray, doc_ids, lengths: np.ndarray, end_id: int) -> bytes:
        """``doc_ids``: ints, or None."""
        n, planes = len(ids), max(1, int(ids.max(initial=0)).bit_length())
        docs = pa.array(doc_ids, pa.int64())
        own = [np.asarray(docs.fill_null(0)).astype("<i8").tobytes(), np.packbits(np.asarray(docs.is_null())).tobytes(), np.asarray(lengths).astype("<u4").tobytes()]
        own = [pa.compress(p, codec="zstd", asbytes=True) if p else b"" for p in own]
        zeros, ranks, blocks = [], [], []
        a, out, one = ids, np.empty_like(ids), np.empty(n, bool)
        for k in range(planes - 1, -1, -1):
            np.not_equal(a & ids.dtype.type(1 << k), 0, out=one)
            packed = np.packbits(one)
            ones = np.bitwise_count(packed)
            sums = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK // 8), dtype=np.int64) if n else np.zeros(0, np.int64)
            ranks.append((np.cumsum(sums) - sums).astype("<u4").tobytes())
            blocks += [pa.compress(packed[b : b + BLOCK_BYTES].tobytes(), codec="zstd", asbytes=True) for b in range(0, len(packed), BLOCK_BYTES)]
            low, high = 0, n - int(sums.sum())
            zeros.append(high)
            for c in range(0, n, _STRIDE):
                here, part = one[c : c + _STRIDE], a[c : c + _STRIDE]
                at = np.flatnonzero(here)
                out[high : high + len(at)] = part[at]
                high += len(at)
                at = np.flatnonzero(~here)
                out[low : low + len(at)] = part[at]
                low += len(at)
            a, out = out, (np.empty_like(ids) if a is ids else a)
        head = HEAD.pack(MAGIC, 2, planes, n, len(docs), end_id)
        sizes = [np.array(zeros, "<u8").tobytes(), np.array([len(p) for p in own], "<u8").tobytes(), np.array([len(p) for p in blocks], "<u4").tobytes()]
        return b"".join([head, *sizes, *own, *ranks, *blocks])

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The doc_ids and each one's number of ids."""
        own = np.frombuffer(self._part(0, 8 * self.n_docs), "<i8")
        null = np.unpackbits(np.frombuffer(self._part(1, -(-self.n_docs // 8)), np.uint8))[: self.n_docs].view(bool)
        return pa.array(own, pa.int64(), mask=null).to_pylist(), np.frombuffer(self._part(2, 4 * self.n_docs), "<u4").astype(np.int64)

    def _unpack(self, k: int, b: int) -> np.ndarray:
        a, z = (int(x) for x in self._blocks[k * self._per_plane + b : k * self._per_plane + b + 2])
        self.unpacked += 1
        return np.frombuffer(pa.decompress(self._read(a, z - a), min(BLOCK_BYTES, -(-self.n // 8) - b * BLOCK_BYTES), codec="zstd", asbytes=True), np.uint8)

    def _block(self, k: int, byte: int) -> np.ndarray:
        """The block of plane k that holds a byte; two blocks a plane are held at a time."""
        key = k * self._per_plane + byte // BLOCK_BYTES
        if key not in self._open:
            if len(self._open) >= 2 * self.planes:
                self._open.pop(next(iter(self._open)))
            self._open[key] = self._unpack(k, byte // BLOCK_BYTES)
        return self._open[key]

    def _rank_table(self, k: int) -> np.ndarray:
        """Ones of plane k before each 512th bit, as stored."""
        if k not in self._before:
            self._before[k] = self._array(self._ranks + 4 * k * self._counts, self._counts, "<u4")
        return self._before[k]

    def _byte(self, k: int, i: int) -> int:
        return int(self._block(k, i // 8)[i // 8 % BLOCK_BYTES])

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before position i."""
        if i >= self.n:
            return self.n - int(self._zeros[k])
        b = i // BLOCK
        n, first, last = int(self._rank_table(k)[b]), b * (BLOCK // 8), i // 8
        if i % BLOCK:
            own = self._block(k, first)[first % BLOCK_BYTES :][: last - first]
            n += int(np.bitwise_count(own).sum(dtype=np.int64))
        return n + (self._byte(k, i) >> (8 - i % 8)).bit_count() if i % 8 else n

    def _down(self, k: int, bit: int, i: int) -> int:
        ones = self._ones(k, i)
        return int(self._zeros[k]) + ones if bit else i - ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k in range(self.planes):
            bit = self._byte(k, i) >> (7 - i % 8) & 1
            out = out << 1 | bit
            i = self._down(k, bit, i)
        return out

    def rank(self, symbol: int, i: int) -> int:
        """How often ``symbol`` is among the first i ids."""
        if symbol >> self.planes:
            return 0
        a, b = 0, i
        for k in range(self.planes):
            bit = symbol >> (self.planes - 1 - k) & 1
            a, b = self._down(k, bit, a), self._down(k, bit, b)
        return b - a

    def count(self, symbol: int, a: int = 0, b: int | None = None) -> int:
        return self.rank(symbol, self.n if b is None else b) - self.rank(symbol, a)

    def select(self, symbol: int, k: int) -> int:
        """Position of the kth (from 0) ``symbol``."""
        if not 0 <= k < self.count(symbol):
            raise IndexError(k)
        a = 0
        for p in range(self.planes):
            a = self._down(p, symbol >> (self.planes - 1 - p) & 1, a)
        i = a + k
        for p in range(self.planes - 1, -1, -1):
            bit = symbol >> (self.planes - 1 - p) & 1
            i = self._find(p, bit, i - int(self._zeros[p]) if bit else i)
        return i

    def _find(self, k: int, bit: int, j: int) -> int:
        """Position of the jth (from 0) ``bit`` in plane k."""
        before = self._rank_table(k).astype(np.int64)
        seen = before if bit else np.arange(len(before)) * BLOCK - before
        b = int(np.searchsorted(seen, j, "right")) - 1
        first = b * (BLOCK // 8)
        bits = np.unpackbits(self._block(k, first)[first % BLOCK_BYTES :][: BLOCK // 8])
        return b * BLOCK + int(np.flatnonzero(bits == bit)[j - int(seen[b])])

    def ids(self) -> np.ndarray:
        """All ids, undone plane by plane from the last."""
        a = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        out = np.empty_like(a)
        for k in range(self.planes - 1, -1, -1):
            low, high = 0, int(self._zeros[k])
            bit = a.dtype.type(1 << (self.planes - 1 - k))
            for b in range(self._per_plane):
                from_bit = 8 * BLOCK_BYTES * b
                one = np.unpackbits(self._unpack(k, b), count=min(8 * BLOCK_BYTES, self.n - from_bit)).view(bool)
                for c in range(0, len(one), _STRIDE):
                    here, to = one[c : c + _STRIDE], out[from_bit + c : from_bit + c + _STRIDE]
                    at = np.flatnonzero(here)
                    to[at] = a[high : high + len(at)] | bit
                    high += len(at)
                    at = np.flatnonzero(~here)
                    to[at] = a[low : low + len(at)]
                    low += len(at)
            a, out = out, a
        return a


class Encoder:
    """Ids of texts by a tokenizers file.

    ``by_word``: for tokenizers whose pre-tokenizer drops white space and whose normaliser works within words, so that a text's ids are
    those of its words in turn (words: between the white space of ASCII). Words are found and told apart by the kernel's 64-bit hashes; those new
    to a piece of text are looked up in a table of fixed size, and encoded if they are new to that too. If the tokenizer lower-cases (read off its
    file), A-Z count as a-z; texts with one of its special tokens, whatever the case, are encoded whole. If the model marks the ends of
    words (``end_of_word_suffix``) and every Latin letter, with marks after it, gives the same ids so, marks at the end of a word count as a word
    of their own, and new lower-case words of Latin letters go to the model many to a text and are told apart by those ends; else words are
    encoded one by one.
    """

    def __init__(self, path: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self.kind = np.uint16 if self._tok.get_vocab_size() <= 1 << 16 else np.uint32
        self._by_word = by_word
        self._bare, self._ends = None, np.zeros(0, bool)
        self._lowers = '"Lowercase"' in (self._tok.normalizer.__getstate__().decode() if self._tok.normalizer else "")
        special = [t.content for t in self._tok.get_added_tokens_decoder().values() if t.content]
        self._special = re.compile(b"|".join(re.escape(t.lower().encode()) for t in special)) if special else None
        if by_word:
            self._shift = np.uint64(64 - (MEMO_SLOTS.bit_length() - 1))
            self._forget()
            self._find_ends(path)

    def _forget(self) -> None:
        self._memo = np.zeros(MEMO_SLOTS, [("h", np.uint64), ("at", np.uint32), ("n", np.uint32)])
        self._ids, self._used = np.zeros(1 << 16, self.kind), 0

    def _find_ends(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        suffix = getattr(self._tok.model, "end_of_word_suffix", None)
        if not suffix:
            return
        self._ends = np.zeros(self._tok.get_vocab_size(), bool)
        self._ends[[k for w, k in self._tok.get_vocab().items() if w.endswith(suffix)]] = True
        bare = Tokenizer.from_file(path)
        bare.normalizer = None
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        letters = [c for c in map(chr, range(0x61, 0x250)) if _LETTERS.fullmatch(c) and c.islower()]
        probes = [*letters, *(f"so{c}me" for c in letters)]
        ids = self._whole(probes)
        marked = all(self._whole([w + m for w in probes]) == [x + own for x in ids] for m, own in zip(_MARKS, self._whole(_MARKS)))
        if marked and ids == self._whole(probes, bare):
            self._bare = bare

    def _whole(self, texts: list[str], tok=None) -> list[bytes]:
        code = "H" if self.kind is np.uint16 else "I"
        return [array(code, e.ids).tobytes() for e in (tok or self._tok).encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Keep the ids of some words, side by side; where each word's begin."""
        if self._used + len(ids) > len(self._ids):
            grown = np.zeros(max(self._used + len(ids), 2 * len(self._ids)), self.kind)
            grown[: self._used] = self._ids[: self._used]
            self._ids = grown
        self._ids[self._used : self._used + len(ids)] = ids
        at = self._used + np.cumsum(size) - size
        self._used += len(ids)
        return at

    def _encode_each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of some words are kept, and how many they are."""
        at, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        rest = np.ones(len(words), bool)
        if self._bare:
            plain = np.array([k for k, w in enumerate(words) if _LETTERS.fullmatch(w) and w.islower()], np.int64)
            texts = [" ".join([words[k] for k in plain[a : a + _TOGETHER].tolist()]) for a in range(0, len(plain), _TOGETHER)]
            ids = np.frombuffer(b"".join(self._whole(texts, self._bare)), self.kind)
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == len(plain):
                size[plain] = own = np.diff(ends, prepend=0)
                at[plain], rest[plain] = self._store(ids, own), False
        rest = np.flatnonzero(rest)
        ids = self._whole([words[k] for k in rest.tolist()])
        size[rest] = own = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind().itemsize
        at[rest] = self._store(np.frombuffer(b"".join(ids), self.kind), own)
        return at, size

    def _marks(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where marks begin that follow a Latin letter and end a word."""
        mark = np.concatenate(([False], _MARK[data], [False]))
        first, last = np.flatnonzero(mark[1:] & ~mark[:-1]), np.flatnonzero(mark[:-1] & ~mark[1:])
        first, last = first[:-1] if len(first) > len(last) else first, last
        at_end = np.zeros(len(data) + 1, bool)
        at_end[off] = True
        edge = at_end[last] | ~kernel.NOT_SPACE[data[np.minimum(last, len(data) - 1)]]
        one, two = data[np.maximum(first - 1, 0)], data[np.maximum(first - 2, 0)]
        # two bytes, U+00C0 to U+027F; the signs of times and division are no letters, and the lower case of a dotted capital i ends in a mark
        latin = (one >= 0x80) & (two >= 0xC3) & (two <= 0xC9) & ~((two == 0xC3) & ((one == 0x97) | (one == 0xB7))) & ~((two == 0xC4) & (one == 0xB0))
        letter = ((one | 32) >= 97) & ((one | 32) <= 122) & (one < 0x80) | latin
        return first[edge & letter & (first > 0)]

    def _piece(self, data: np.ndarray, off: np.ndarray, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if self._used > MEMO_IDS:
            self._forget()
        cuts = np.sort(np.concatenate((off, self._marks(data, off))), kind="stable") if self._bare and len(data) else off
        h, start, stop, _ = kernel.words(data, cuts, kernel.NOT_SPACE, self._lowers)
        w = np.searchsorted(start, off)
        raw = data.tobytes()
        folded = raw.lower() if self._lowers else raw  # of bytes: A-Z alone
        for k in np.flatnonzero(stop - start > LONG_WORD):
            h[k] = xxhash.xxh3_64_intdigest(folded[start[k] : stop[k]])
        coded = pa.array(h).dictionary_encode()
        own, of = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        first = np.empty(len(own), np.int64)
        first[of] = np.arange(len(of))
        slot = (own >> self._shift).astype(np.intp)
        row = self._memo[slot]
        known = (row["h"] == own) & (row["n"] > 0)
        at, size = row["at"].astype(np.int64), row["n"].astype(np.int64)
        new = np.flatnonzero(~known)
        spelt = [folded[a:b].decode() for a, b in zip(start[first[new]].tolist(), stop[first[new]].tolist())]
        if self._lowers:  # letters of the Latin blocks have one lower case of one letter
            spelt = [x if x.isascii() or _BEYOND_LATIN.search(x) else x.lower() for x in spelt]
        at[new], size[new] = self._encode_each(spelt)
        fresh = np.zeros(len(new), self._memo.dtype)
        fresh["h"], fresh["at"], fresh["n"] = own[new], at[new], size[new]
        self._memo[slot[new]] = fresh
        at, size = at[of], size[of]
        if self._special and self._special.search(seen := raw.lower()):
            odd = sorted({int(np.searchsorted(off, m.start(), "right")) - 1 for m in self._special.finditer(seen)})
            for k in odd:
                ids = np.frombuffer(self._whole([raw[off[k] : off[k + 1]].decode()])[0], self.kind)
                size[w[k] : w[k + 1]] = 0
                at[w[k]], size[w[k]] = self._store(ids, np.array([len(ids)]))[0], len(ids)
        if end:
            tail = self._store(np.array(end, self.kind), np.array([len(end)]))[0]
            at, size = np.insert(at, w[1:], tail), np.insert(size, w[1:], len(end))
            w = w + np.arange(len(w))
        to = np.concatenate(([0], np.cumsum(size)))
        ids = self._ids[np.repeat(at - to[:-1], size) + np.arange(to[-1])]
        return ids, to[w]

    def encode_column(self, column: pa.Array, end: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The ids of some texts at a time, each with ``end`` after it: number of the first text, ids, and the offsets of each text's."""
        if not self._by_word:
            for a in range(0, len(column), 256):
                tail = np.array(end, self.kind).tobytes()
                own = [x + tail for x in self._whole(column.slice(a, 256).fill_null("").to_pylist())]
                yield a, np.frombuffer(b"".join(own), self.kind), np.concatenate(([0], np.cumsum([len(x) for x in own]))) // self.kind().itemsize
            return
        data, off = kernel.text_bytes(column)
        for i, j in kernel.pieces(off):
            yield i, *self._piece(data[off[i] : off[j]], off[i : j + 1] - off[i], end)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [ids[a:b].tobytes() for _, ids, to in self.encode_column(pa.array(texts, pa.string()), []) for a, b in zip(to[:-1], to[1:])]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, by_word: bool) -> Encoder:
    """A worker's own encoder, kept from task to task and dropped when the worker stands idle."""
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = Encoder(path, by_word)
    keep_warm(_encoders)
    return _encoders[path, by_word]


def _encode_pass(path: str, by_word: bool, end_id: int, sent):
    """Encodes, and gives each row its range: by doc_id among the cuts; rows of a null id, or of one that spans several ranges, by a hash of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, by_word)
        cuts, n_null = sent.value
        for batch in batches:
            doc = batch.column("doc_id")
            null, own = np.asarray(doc.is_null()), np.asarray(doc.fill_null(0))
            low, high = np.searchsorted(cuts, own, "left"), np.searchsorted(cuts, own, "right")
            low, high = np.where(null, 0, low + n_null), np.where(null, max(n_null, 1) - 1, high + n_null)
            spread = (high > low + 1) | null
            high = np.where(spread, high, low)
            for i, ids, to in enc.encode_column(batch.column("text"), [end_id]):
                m = len(to) - 1
                at, tie = low[i : i + m].copy(), np.zeros(m, np.uint64)
                for k in np.flatnonzero(spread[i : i + m]):
                    tie[k] = xxhash.xxh3_64_intdigest(ids[to[k] : to[k + 1]].tobytes()) >> 1
                    at[k] += int(tie[k]) * int(high[i + k] - at[k] + 1) >> 63
                raw = pa.Array.from_buffers(pa.large_binary(), m, [None, pa.py_buffer((to * ids.itemsize).astype(np.int64)), pa.py_buffer(ids)])
                yield pa.record_batch([pa.array(at, pa.int32()), doc.slice(i, m), pa.array(tie.view(np.int64)), raw.cast(pa.binary())], names=["range", "doc_id", "tie", "ids"])

    return run


def _write_pass(folder: str, end_id: int, wide: bool, shard_tokens: int):
    kind = np.uint32 if wide else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, docs, held, n, attempt = None, 0, [], [], 0, files.attempt()

        def flush():
            lengths = np.array([len(x) // kind().itemsize for x in held], np.int64)
            uri = f"{folder}/part-{at:06d}-{seq:06d}-{attempt}.twm"
            files.write_file(uri, WaveletFile.encode(np.frombuffer(b"".join(held), kind), docs, lengths, end_id))
            return pa.record_batch([[uri], pa.array([at], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([n], pa.int64())], names=["path", "range", "seq", "n_docs", "n_tokens"])

        for batch in batches:
            for r, d, x in zip(batch.column("range").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                size = len(x) // kind().itemsize
                if docs and (r != at or n + size > shard_tokens):
                    yield flush()
                    seq, docs, held, n = seq + 1 if r == at else 0, [], [], 0
                if r != at:
                    at, seq = r, 0
                docs.append(d)
                held.append(x)
                n += size
        if docs:
            yield flush()

    return run


def _cuts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Where ranges of doc_ids of about ``RANGE_BYTES`` end, and how many further ranges the null ids fill. Only the id column is read: the
    bytes are the planner's, from the sizes of the files."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    rows, nulls = ids.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    stored = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2
    n = max(1, min(rows // 256, max(least, -(-stored // RANGE_BYTES))))
    n_null = -(-n * nulls // rows) if nulls else 0
    n -= n_null
    cuts = ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else []
    return np.array(sorted(map(int, cuts)), np.int64), n_null


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2, by_word: bool = False, wide: bool = False, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs(doc_id integer, text)`` and write shard files under ``folder`` (shared storage).

    Returns the manifest ``(path, range, seq, n_docs, n_tokens)``; ``range`` and ``seq`` give the shards' order. Ranges of
    doc_ids come from quantiles of the id column alone (the texts are read once). Null ids come first. Rows of equal ids lie in the order of their ids'
    bytes, or of a hash of them where an id has so many rows that they fill several ranges. Null texts are empty and hold the end id only. Extra columns are
    not read. An empty table gives no file. ``wide``: 32-bit ids, for vocabularies beyond 65,536.
    """
    tidy(docs.sparkSession)
    files.make_folder(folder)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts, n_null = _cuts(docs)
    sent = docs.sparkSession.sparkContext.broadcast((cuts, n_null))  # eight bytes for each RANGE_BYTES of documents
    rows = docs.mapInArrow(releasing(_encode_pass(path, by_word, end_id, sent)), "range int, doc_id long, tie long, ids binary")
    rows = rows.repartitionById(len(cuts) + 1 + n_null, "range").sortWithinPartitions("range", "doc_id", "tie", "ids").select("range", "doc_id", "ids")
    return materialize(rows.mapInArrow(releasing(_write_pass(folder, end_id, wide, shard_tokens)), "path string, range int, seq int, n_docs long, n_tokens long"), "manifest")


def read_digests(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read from the files; a task reads the files of a range."""

    def run(batches):
        for batch in batches:
            for uri, r, s in zip(*(batch.column(c).to_pylist() for c in ("path", "range", "seq"))):
                with files.open_file(uri) as opened:
                    f = WaveletFile(opened)
                    docs, lengths = f.documents()
                    ids = f.ids()
                to = np.cumsum(lengths)
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip((to - lengths).tolist(), to.tolist())]
                yield pa.record_batch(
                    [pa.array([r] * len(docs), pa.int32()), pa.array([s] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(to - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["range", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    ranges = manifest.groupBy("range").agg(F.sum("n_tokens").alias("n"))  # a row for each RANGE_BYTES of documents
    count = (ranges.agg(F.max("range")).first()[0] or 0) + 1
    docs = manifest.select("path", "range", "seq").repartitionById(count, "range").mapInArrow(releasing(run), "range int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    ranges = ranges.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("base"))
    shards = manifest.select("range", "seq", (F.sum("n_tokens").over(Window.partitionBy("range").orderBy("seq")) - F.col("n_tokens")).alias("before"))
    shards = shards.join(ranges, "range").select("range", "seq", (F.col("base") + F.col("before")).alias("base"))
    # the planner takes what is read from the files for as small as their names: it must not be the side that is sent
    small = 64 * manifest.count() <= BROADCAST_BYTES
    shards = F.broadcast(shards) if small else shards.hint("shuffle_merge")
    return docs.join(shards, ["range", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_all(docs: DataFrame, path: str, end_id: int = 2, by_word: bool = False, wide: bool = False) -> DataFrame:
    """Write all documents to files on shared storage and return what reading them back gives."""
    return read_digests(write(docs, fresh_path(docs.sparkSession, "tokens"), path, end_id, by_word, wide))
