"""Prediction by partial matching over bytes: a trie of contexts, escape estimation, symbol exclusion.

The trie is kept as sorted arrays, one level for each order. A level has the (context, symbol) counts
and, for each context, its total n and number of distinct symbols d. Escapes follow method C: a symbol
seen c times has c / (n + d), the escape d / (n + d). After an escape the symbols of the longer context
are excluded: they are a subset of those of the shorter one, so what is to be taken off n and d is
known for each longer context and is stored with it. Below order 0 the symbols not seen at all share
what is left evenly. Byte 0xFF, which UTF-8 has not, stands before a text and ends it.

A trie may hold a range of the contexts only, in the order of :func:`turned`. A lower context is then
either within the range, with all its strings, or one that a bound of the range cuts; the strings of
the cut ones are given as ``edges``. So each string of the range gets the score of the whole trie.
"""

import numpy as np

from .textops import mix

MARK = 0xFF
EMPTY = np.uint64((1 << 64) - 1)


def framed(data: np.ndarray, offsets: np.ndarray, order: int):
    """(buffer with marks, first symbol and end of each row in it); the end symbol counts in."""
    sizes = np.diff(offsets)
    n = len(sizes)
    buffer = np.full(len(data) + (order + 1) * n, MARK, dtype=np.uint8)
    shift = order + (order + 1) * np.arange(n, dtype=np.int64)
    buffer[np.arange(len(data)) + np.repeat(shift, sizes)] = data
    begin = offsets[:-1] - offsets[0] + shift
    return buffer, begin, begin + sizes + 1


def grams(buffer: np.ndarray, order: int) -> np.ndarray:
    """For each position from ``order``: context and symbol as one number, the symbol lowest."""
    out = np.zeros(max(0, len(buffer) - order), dtype=np.uint64)
    for j in range(order + 1):
        out <<= np.uint64(8)
        out |= buffer[j : j + len(out)]
    return out


def symbol_rows(begin: np.ndarray, end: np.ndarray, order: int) -> np.ndarray:
    """Positions in grams() that are symbols of a row, not its marks before."""
    keep = np.zeros(int(end[-1]) - order if len(end) else 0, dtype=np.int8)
    keep[begin - order] = 1
    stop = end[:-1] - order
    keep[stop] -= 1
    return np.cumsum(keep, dtype=np.int8).astype(bool)


def turned(strings: np.ndarray, order: int) -> np.ndarray:
    """The context of each gram with its nearest byte highest: contexts that share an end lie together."""
    if not order:
        return np.zeros(len(strings), dtype=np.uint64)
    return (strings.astype(np.uint64).byteswap() << np.uint64(8)) >> np.uint64(64 - 8 * order)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Trie:
    """``keys``: grams of the top order with ``counts``. Probabilities are log10.

    ``edges``: by level below the top, grams with counts that stand for those of their contexts.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, edges: dict | None = None):
        self.order = order
        keys, counts = np.asarray(keys, dtype=np.uint64), np.asarray(counts, dtype=np.int64)
        level = keys[np.argsort(keys)], counts[np.argsort(keys)]
        self.levels: list[dict] = []
        for k in range(order, -1, -1):
            keys, counts = level
            if edges and k < order:
                more, n = edges[k]
                own = find(np.unique(more >> np.uint64(8)), keys >> np.uint64(8)) < 0
                keys, counts = np.concatenate([keys[own], more]), np.concatenate([counts[own], n])
                keys, counts = keys[by := np.argsort(keys)], counts[by]
            contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
            self.levels.append({"keys": keys, "counts": counts, "contexts": contexts, "n": np.add.reduceat(counts, first) if len(keys) else counts, "d": np.diff(np.append(first, len(keys)))})
            if k:
                lower = keys & np.uint64((1 << (8 * k)) - 1)
                short, inverse = np.unique(lower, return_inverse=True)
                level = short, np.bincount(inverse, weights=counts, minlength=len(short)).astype(np.int64) if len(keys) else counts
        for upper, lower in zip(self.levels, self.levels[1:]):
            k = self.order - self.levels.index(upper)
            same = find(lower["keys"], upper["keys"] & np.uint64((1 << (8 * k)) - 1))
            first = np.concatenate([[0], np.cumsum(upper["d"])[:-1]]).astype(np.int64)
            upper["taken"] = np.add.reduceat(lower["counts"][same], first) if len(same) else np.zeros(0, np.int64)
        self.table = None

    def sparse(self, wanted: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol in its context, level by level."""
        wanted = np.asarray(wanted, dtype=np.uint64)
        out = np.zeros(len(wanted))
        live = np.arange(len(wanted))
        up_n = np.zeros(len(wanted), dtype=np.int64)
        up_d = np.zeros(len(wanted), dtype=np.int64)
        for i, level in enumerate(self.levels):
            k = self.order - i
            g = wanted[live] & np.uint64((1 << (8 * (k + 1))) - 1)
            row = find(level["contexts"], g >> np.uint64(8))
            seen = row >= 0
            at = find(level["keys"], g)
            total = np.where(seen, level["n"][row] + level["d"][row] - up_n[live] - up_d[live], 0) if len(level["n"]) else np.zeros(len(live), np.int64)
            hit = at >= 0
            out[live[hit]] += np.log10(level["counts"][at[hit]] / total[hit])
            escape = ~hit & (total > 0)
            if escape.any():
                out[live[escape]] += np.log10((level["d"][row[escape]] - up_d[live[escape]]) / total[escape])
            left = ~hit & seen
            up_d[live[left]] = level["d"][row[left]]
            if "taken" in level:
                up_n[live[left]] = level["taken"][row[left]]
            live = live[~hit]
        if len(live):
            out[live] -= np.log10(256 - (self.levels[-1]["d"][0] if len(self.levels[-1]["d"]) else 0))
        return out

    def _probe(self, wanted: np.ndarray) -> np.ndarray:
        return (mix(wanted) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ready(self) -> "Trie":
        """Builds an open-addressing table of the top order with the probability of each seen symbol."""
        top = self.levels[0]
        if self.table is None and len(top["keys"]):
            row = np.repeat(np.arange(len(top["n"])), top["d"])
            value = np.log10(top["counts"] / (top["n"] + top["d"])[row]).astype(np.float32)
            self.bits = max(4, int(len(row) * 3 // 2 - 1).bit_length())
            self.table = np.full(1 << self.bits, EMPTY, dtype=np.uint64), np.zeros(1 << self.bits, dtype=np.float32)
            slot, todo = self._probe(top["keys"]), np.arange(len(row))
            while len(todo):
                at = slot[todo]
                free = self.table[0][at] == EMPTY
                self.table[0][at[free]] = top["keys"][todo[free]]  # of several at one slot, the last stays
                put = self.table[0][at] == top["keys"][todo]
                self.table[1][at[put]] = value[todo[put]]
                todo = todo[~put]
                slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return self

    def score(self, wanted: np.ndarray) -> np.ndarray:
        """As sparse(), with one probe sequence for what the top order has seen."""
        if self.table is None:
            return self.sparse(wanted)
        keys, values = self.table
        slot = self._probe(wanted)
        found = keys[slot]
        out = values[slot].astype(np.float64)
        live = np.flatnonzero(found != wanted)
        slot, found = slot[live], found[live]
        missing = []
        while len(live):
            gone = found == EMPTY
            missing.append(live[gone])
            live, slot = live[~gone], (slot[~gone] + 1) & ((1 << self.bits) - 1)
            found = keys[slot]
            hit = found == wanted[live]
            out[live[hit]] = values[slot[hit]]
            live, slot, found = live[~hit], slot[~hit], found[~hit]
        if missing:
            at = np.concatenate(missing)
            out[at] = self.sparse(wanted[at])
        return out
