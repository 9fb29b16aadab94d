"""Array helpers for Arrow batches of texts.

Words are maximal runs of bytes other than space and 0x09-0x0D, which are the
same in UTF-8 as in code points.  Each word becomes a 64-bit hash; all words of
a block of documents are hashed in a few array operations.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SEGMENT = 1 << 19
BLOCK = 1 << 21


def mix(x):
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def text_buffers(column):
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def document_blocks(offs, limit=BLOCK):
    """(first, last) ranges of documents of at most ``limit`` bytes, or of a single one."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class WordHasher:
    """Hashes the words of blocks of documents; keeps the tables of powers."""

    def __init__(self, lower=False):
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[65:91] += 32
        self.power = self.inverse = np.ones(0, np.uint64)

    def tables(self, n):
        if len(self.power) < n:
            ones = np.full(max(n, SEGMENT * 2), BASE, np.uint64)
            ones[0] = 1
            self.power = np.cumprod(ones, dtype=np.uint64)
            ones[1:] = INVERSE
            self.inverse = np.cumprod(ones, dtype=np.uint64)

    def segments(self, data):
        """Bounds of pieces that end at white space, so that no word is cut."""
        at, n = 0, len(data)
        while at < n:
            end = min(at + SEGMENT, n)
            while end < n:
                gaps = np.flatnonzero(self.space[data[max(at, end - SEGMENT) : end]])
                if len(gaps):
                    end = max(at, end - SEGMENT) + int(gaps[-1]) + 1
                    break
                end = min(end + SEGMENT, n)
            yield at, end
            at = end

    def words(self, data, offs):
        """(hashes, starts, ends, first word of each document and the total)."""
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        hashes, starts, ends = [], [], []
        for a, b in self.segments(data):
            piece = self.fold[data[a:b]]
            inside = ~self.space[piece]
            before = np.empty(b - a, bool)
            before[0], before[1:] = False, inside[:-1]
            before &= ~edge[a:b]
            after = np.empty(b - a, bool)
            after[-1], after[:-1] = False, inside[1:]
            after &= ~edge[a + 1 : b + 1]
            s = np.flatnonzero(inside & ~before)
            e = np.flatnonzero(inside & ~after) + 1
            self.tables(b - a)
            summed = np.zeros(b - a + 1, np.uint64)
            np.cumsum((piece.astype(np.uint64) + U(1)) * self.power[: b - a], out=summed[1:])
            raw = (summed[e] - summed[s]) * self.inverse[s]
            hashes.append(mix(raw + (e - s).astype(np.uint64) * U(0xA0761D6478BD642F)))
            starts.append(s + a)
            ends.append(e + a)
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        return hashes, starts, ends, np.searchsorted(starts, offs)


def rolled(hashes, k):
    """Hash of every k consecutive words."""
    n = max(len(hashes) - k + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * U(BASE) + hashes[j : j + n]
    return mix(h)


def sliding_min(x, w):
    """Minimum of every w consecutive values."""
    n = max(len(x) - w + 1, 0)
    out = x[:n].copy()
    for j in range(1, w):
        np.minimum(out, x[j : j + n], out=out)
    return out
