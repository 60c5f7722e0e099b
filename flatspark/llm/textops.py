"""Vectorised kernels over the UTF-8 bytes of whole Arrow batches.

Every text operator of this subpackage reads its column as one byte buffer with row offsets, so no
Python string is made for a row unless a result needs one. Work is cut into slices of about
``SLICE`` bytes, so the memory of a task does not depend on how many rows an Arrow batch holds; a
single longer text makes a slice of its own.
"""

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE):
    """Row ranges of about ``size`` bytes that cover all rows."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def powers(n: int, base=BASE) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Start, end (in bytes of the slice), row and 64-bit hash of all words of a slice of rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, table: tuple[np.ndarray, np.ndarray]):
        offsets = offsets - offsets[0]
        inside = kind[data]
        n = len(data)
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | cut[1:-1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.count = np.bincount(self.row, minlength=len(offsets) - 1)
        self.bounds = np.concatenate([[0], np.cumsum(self.count)])
        up, down = table
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(LOWER[data] * up[:n], dtype=np.uint64, out=total[1:])
        length = (self.end - self.start).astype(np.uint64)
        self.total, self.down = total, down
        self.hash = mix(((total[self.end] - total[self.start]) * down[self.start]) ^ (length * np.uint64(0xD6E8FEB86659FD93)))


    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index and hash of the first ``size`` bytes of the words that are as long."""
        at = np.flatnonzero(self.end - self.start >= size)
        start = self.start[at]
        return at, mix(((self.total[start + size] - self.total[start]) * self.down[start]) ^ np.uint64(size * 0x9FB21C651E98DF25 & (1 << 64) - 1))


class Tokenizer:
    """Makes :class:`Words` with power tables that grow to the longest slice seen."""

    def __init__(self, kind: np.ndarray):
        self.kind, self.size, self.table = kind, 0, None

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        if self.table is None or len(data) > self.size:
            self.size = max(len(data), SLICE + (SLICE >> 2))
            self.table = powers(self.size + 1), powers(self.size + 1, UNBASE)
        return Words(data, offsets, self.kind, self.table)


def word_hash(word: bytes) -> int:
    """The hash that :class:`Words` gives to one (lower-cased) word."""
    data = np.frombuffer(word, dtype=np.uint8)
    total = np.sum(LOWER[data] * powers(len(data)), dtype=np.uint64)
    return int(mix(np.array([total], np.uint64) ^ (np.array([len(data)], np.uint64) * np.uint64(0xD6E8FEB86659FD93)))[0])


class HashSet:
    """Membership and position of 64-bit hashes in a sorted table, behind a one-byte filter."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(np.asarray(keys, dtype=np.uint64))
        self.filter = np.zeros(1 << self.BITS, dtype=bool)
        self.filter[self.keys >> np.uint64(64 - self.BITS)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index into ``keys``, or -1."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        if len(self.keys) and len(hashes):
            maybe = np.flatnonzero(self.filter[hashes >> np.uint64(64 - self.BITS)])
            got = hashes[maybe]
            at = np.minimum(np.searchsorted(self.keys, got), len(self.keys) - 1)
            same = self.keys[at] == got
            out[maybe[same]] = at[same]
        return out


def char_positions(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position (n + 1 entries)."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
