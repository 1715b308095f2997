"""Vectorised word and shingle hashing over Arrow text columns.

Words are maximal runs of word bytes (every byte of a multi-byte UTF-8 character is one). A word's
64-bit hash is a polynomial over its bytes, read off prefix sums, so that the cost is a few array
passes over the bytes and does not depend on the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .runtime import keep_warm

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240613))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_GRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_RNG.integers(1, 2**61, dtype=np.uint64)) * 4 + 3
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes worked on at a time, so that the arrays stay in cache.
PIECE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] of the lower-cased text, so A-Z count
ALNUM = np.ones(256, dtype=bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    ALNUM[_a : _b + 1] = False

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n``."""
    up, down = _powers.get("up"), _powers.get("down")
    if up is None or down is None or len(up) < n:
        size = max(n, PIECE + 1)
        up, down = np.full(size, U(_BASE)), np.full(size, U(_INVERSE))
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if n <= 4 * PIECE:  # a table for a single giant word is not kept
            _powers["up"], _powers["down"] = up, down
            keep_warm(_powers)
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(29))
    h = h * U(0x9E3779B97F4A7C15)
    return h ^ (h >> U(32))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: empty) and the offsets of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of ``most`` bytes at most, or of one longer document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def _words(data: np.ndarray, off: np.ndarray, kind: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = kind[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    before = np.empty_like(own)
    before[0], before[1:] = False, own[:-1]
    start = np.flatnonzero(own & (~before | edge[:-1]))
    after = np.empty_like(own)
    after[-1], after[:-1] = False, own[1:]
    end = np.flatnonzero(own & (~after | edge[1:])) + 1
    up, down = _power_tables(len(data))
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[LOWER[data] if fold else data] * up[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64)), start, end


def _gap(data: np.ndarray, kind: np.ndarray, at: int) -> int:
    """The first byte from ``at`` on that is in no word, or the end."""
    while at < len(data):
        found = np.flatnonzero(~kind[data[at : at + 4096]])
        if len(found):
            return at + int(found[0])
        at += 4096
    return len(data)


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes (``fold``: letters A-Z as a-z), their first and past-the-end bytes, and the offsets of each document's words.

    Bytes are worked on a piece at a time, cut between words, so that a very long document costs little besides what is returned.
    """
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    if len(data) <= 2 * PIECE:
        h, start, end = _words(data, off, kind, fold)
        return h, start, end, np.searchsorted(start, off)
    parts, at = [], 0
    while at < len(data):
        to = _gap(data, kind, min(len(data), at + PIECE))
        inner = off[np.searchsorted(off, at) : np.searchsorted(off, to, "right")] - at
        h, start, end = _words(data[at:to], inner, kind, fold)
        parts.append((h, start + at, end + at))
        at = to
    h, start, end = (np.concatenate(x) for x in zip(*parts))
    return h, start, end, np.searchsorted(start, off)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i:i+n] for each i that has n words after it in the array."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    g = np.full(len(h) - n + 1, U(n * 0x2545F4914F6CDD1D % 2**64))
    for j in range(n):
        g += h[j : len(h) - n + 1 + j] * _GRAM[j]
    return mix(g)


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int, kind: np.ndarray = NOT_SPACE) -> Iterator[np.ndarray]:
    """Each document's sorted set of n-word shingle hashes; fewer words make one shingle, none the empty set."""
    for i, j in pieces(off):
        o = off[i : j + 1] - off[i]
        h, _, _, w = words(data[off[i] : off[j]], o, kind)
        g = grams(h, n)
        for k in range(j - i):
            a, b = w[k], w[k + 1]
            if b - a >= n:
                yield np.unique(g[a : b - n + 1])
            elif b > a:
                yield grams(h[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)
