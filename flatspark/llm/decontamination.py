"""Benchmark decontamination with an FM-index for each shard of training text.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is 13 consecutive words of a
benchmark item, or all words of a shorter one. Each task turns its documents into shards of a few
megabytes. The index is over a shard's words in the alphabet of the benchmark: a word that no item has
ends a run, as no window reaches over it, and runs shorter than the shortest window cannot hold one.
Over the runs it builds a suffix array, its Burrows-Wheeler transform and a wavelet matrix; all windows
are searched backwards at once through its ranks, occurrences are located from sampled suffix
positions, and the word ranges they cover are merged into removal spans.

The benchmark goes to the executors in blocks of about ``BLOCK`` bytes of text. The driver turns a block
into arrays of its different windows, some 60 bytes each, and broadcasts them; a task holds one block at
a time; a larger benchmark means more blocks, not more memory. Documents are not shuffled.

Defined results: a null or empty text or item has no words; an item without words has no window; the
windows of an item with a null id count as hits, but it is not among n_items and items_sha256;
repeated rows give repeated results; rows with a null id are scored like others; an empty table gives
an empty result; other columns of the input do not matter.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table
from .textops import ALNUM, HashSet, Tokenizer, char_positions, slices, text_buffer

WINDOW = 13
BLOCK = 8 << 20
SHARD = 4 << 20
SAMPLE = 8

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"


class FMIndex:
    """FM-index of integer runs. ``text`` has symbols from 1; ``first`` marks where a run begins.

    A separator, smaller than all symbols and different for each run, ends each run, so suffixes never
    compare beyond their run. In the transform all separators count as symbol 0, which is never
    searched, and the first position of each run is sampled, so locating never crosses one.
    """

    def __init__(self, text: np.ndarray, first: np.ndarray, sample: int = SAMPLE):
        starts = np.flatnonzero(first)
        runs = len(starts)
        n = len(text) + runs
        run = np.cumsum(first) - 1
        at = np.arange(len(text)) + run
        whole = np.zeros(n, dtype=np.int64)
        whole[at] = text
        stops = np.append(starts[1:], len(text)) + np.arange(runs)
        rank = whole + runs
        rank[stops] = np.arange(runs)
        step = 1
        order = np.argsort(rank, kind="stable")
        ranks = self._dense(rank[order], order, n)
        while ranks[order[-1]] < n - 1:
            key = ranks * (n + 1)
            key[:-step] += ranks[step:] + 1
            order = np.argsort(key, kind="stable")
            ranks = self._dense(key[order], order, n)
            step *= 2
        self.n, self.whole = n, whole
        bwt = whole[order - 1]
        self.sigma = int(whole.max()) + 1 if n else 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(whole, minlength=self.sigma))])
        self._wavelet(bwt)
        keep = order % sample == 0
        keep |= np.isin(order, at[starts])
        self.kept = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(keep, out=self.kept[1:])
        self.keep, self.samples = keep, order[keep]
        self.origin = np.full(n, -1, dtype=np.int64)
        self.origin[at] = np.arange(len(text))

    @staticmethod
    def _dense(sorted_keys: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
        out = np.empty(n, dtype=np.int64)
        out[order] = np.concatenate([[0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])]) if n else 0
        return out

    def _wavelet(self, seq: np.ndarray) -> None:
        self.levels = []
        for bit in range(max(1, int(self.sigma - 1).bit_length()) - 1, -1, -1):
            ones = (seq >> bit) & 1
            ranks = np.zeros(len(seq) + 1, dtype=np.int32)
            np.cumsum(ones, out=ranks[1:])
            self.levels.append((bit, ranks, len(seq) - int(ranks[-1])))
            seq = np.concatenate([seq[ones == 0], seq[ones == 1]])
        self.base = np.zeros(self.sigma, dtype=np.int64)
        self.base = self._descend(np.arange(self.sigma), np.zeros(self.sigma, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, ranks, zeros in self.levels:
            ones = ranks[i]
            i = np.where((symbol >> bit) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before row i of the transform."""
        return self._descend(symbol, i) - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the suffixes that begin with each pattern (rows of equal length)."""
        lo = np.zeros(len(patterns), dtype=np.int64)
        hi = np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, j]
            known = (symbol > 0) & (symbol < self.sigma)
            hi[live[~known]] = lo[live[~known]]
            live, symbol = live[known], symbol[known]
            lo[live] = self.before[symbol] + self.rank(symbol, lo[live])
            hi[live] = self.before[symbol] + self.rank(symbol, hi[live])
            live = live[hi[live] > lo[live]]
            if not len(live):
                break
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Index into ``text`` at which the suffix of each row begins."""
        rows = rows.copy()
        steps = np.zeros(len(rows), dtype=np.int64)
        live = np.flatnonzero(~self.keep[rows])
        while len(live):
            i = rows[live]
            symbol = np.zeros(len(i), dtype=np.int64)
            for bit, ranks, zeros in self.levels:
                ones = ranks[i]
                one = ranks[i + 1] - ones
                symbol |= one.astype(np.int64) << bit
                i = np.where(one, zeros + ones, i - ones)
            rows[live] = self.before[symbol] + i - self.base[symbol]
            steps[live] += 1
            live = live[~self.keep[rows[live]]]
        return self.origin[self.samples[self.kept[rows]] + steps]


def window_arrays(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> tuple:
    """What a block of items is searched for, as arrays.

    Sorted word hashes; for each length of windows a matrix of symbols (places of words in the former, from
    1), bounds and places of their items; and the items' names.
    """
    data = np.frombuffer(b"".join(t for _, t in items), dtype=np.uint8)
    words = Tokenizer(ALNUM)(data, np.concatenate([[0], np.cumsum([len(t) for _, t in items], dtype=np.int64)]))
    vocabulary, symbol = np.unique(words.hash, return_inverse=True)
    symbol = symbol.astype(np.int32) + np.int32(1)
    names = sorted({item for item, _ in items if item is not None})
    place = {name: i for i, name in enumerate(names)}
    of_row = np.array([-1 if item is None else place[item] for item, _ in items], dtype=np.int64)
    size = np.minimum(words.count, window)
    groups = []
    for n in np.unique(size[size > 0]).tolist():
        each = (words.count - n + 1) * (size == n)
        row = np.repeat(np.arange(len(items)), each)
        start = np.repeat(words.bounds[:-1], each) + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        parts = np.ascontiguousarray(symbol[start[:, None] + np.arange(n)])
        _, first, which = np.unique(parts.view(np.dtype((np.void, 4 * n))).ravel(), return_index=True, return_inverse=True)
        pairs = np.unique(which[of_row[row] >= 0] * max(1, len(names)) + of_row[row][of_row[row] >= 0])
        bounds = np.searchsorted(pairs, np.arange(len(first) + 1) * max(1, len(names)))
        groups.append((n, parts[first], bounds, (pairs % max(1, len(names))).astype(np.int32)))
    return vocabulary, groups, names


class Windows:
    """The windows of a block of items, ready to be searched."""

    def __init__(self, arrays: tuple):
        vocabulary, self.groups, self.names = arrays
        self.vocabulary = HashSet(vocabulary)
        self.shortest = min((n for n, *_ in self.groups), default=0)


def occurrences(words_hash: np.ndarray, row: np.ndarray, windows: Windows):
    """(first word, length, window, bounds and places of the windows' items) of all that occur in the rows' words."""
    if not len(words_hash) or not windows.groups:
        return
    known = windows.vocabulary.find(words_hash)
    at = np.flatnonzero(known >= 0)
    if not len(at):
        return
    first = np.ones(len(at), dtype=bool)
    first[1:] = (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])
    starts = np.flatnonzero(first)
    long_enough = np.diff(np.append(starts, len(at))) >= windows.shortest
    chosen = long_enough[np.cumsum(first) - 1]
    at, first = at[chosen], first[chosen]
    if not len(at):
        return
    index = FMIndex(known[at] + 1, first)
    for size, patterns, bounds, items in windows.groups:
        lo, hi = index.search(patterns)
        hit = np.flatnonzero(hi > lo)
        if len(hit):
            many = (hi - lo)[hit]
            rows = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            yield at[index.locate(rows)], size, np.repeat(hit, many), bounds, items


class Shard:
    """Words of the documents of a shard, and what the benchmark hits in them."""

    def __init__(self, column, blocks):
        data, offsets = text_buffer(column)
        self.data, self.offsets = data, offsets
        tokenize = Tokenizer(ALNUM)
        parts, base = [], 0
        for lo, hi in slices(offsets):
            w = tokenize(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
            parts.append((w.hash, w.row + lo, w.start + offsets[lo], w.end + offsets[lo]))
        if parts:
            self.hash, self.row, self.start, self.end = (np.concatenate(x) for x in zip(*parts))
        else:
            self.hash, self.row, self.start, self.end = np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
        self.n_rows = len(offsets) - 1
        self.n_words = np.bincount(self.row, minlength=self.n_rows)
        self.items: dict[int, set] = {}
        cover = np.zeros(len(self.hash) + 1, dtype=np.int64)
        for block in blocks:
            for begin, size, which, bounds, items in occurrences(self.hash, self.row, block):
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + size, -1)
                n = len(bounds)
                for p in np.unique(self.row[begin] * n + which).tolist():
                    lo, hi = bounds[p % n : p % n + 2]
                    self.items.setdefault(p // n, set()).update(block.names[i] for i in items[lo:hi].tolist())
        self.hit = np.cumsum(cover[:-1]) > 0
        self.n_hit = np.bincount(self.row[self.hit], minlength=self.n_rows)
        self.contaminated = (self.n_hit > 0) & (20 * self.n_hit >= self.n_words)

    def spans(self):
        """Row, start and end (bytes) of the merged removal spans."""
        at = np.flatnonzero(self.hit)
        if not len(at):
            return np.zeros((3, 0), dtype=np.int64)
        first = np.ones(len(at), dtype=bool)
        first[1:] = (np.diff(at) > 1) | (self.row[at[1:]] != self.row[at[:-1]])
        last = np.append(first[1:], True)
        return np.stack([self.row[at[first]], self.start[at[first]], self.end[at[last]]])


def shard_tables(batches, size: int = SHARD):
    """Batches cut and joined to tables of about ``size`` bytes of text (column ``text``)."""
    held, total = [], 0
    for batch in batches:
        _, offsets = text_buffer(batch.column("text"))
        for lo, hi in slices(offsets, size):
            held.append(batch.slice(lo, hi - lo))
            total += int(offsets[hi] - offsets[lo])
            if total >= size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def opened(broadcasts):
    """Blocks one at a time; of several, none stays in memory."""
    for b in broadcasts:
        if not hasattr(b, "_windows"):
            windows = Windows(b.value)
            if len(broadcasts) > 1:
                b.__dict__.pop("_value", None)
            else:
                b._windows = windows
            yield windows
        else:
            yield b._windows


def scores(broadcasts):
    def run(batches):
        for t in shard_tables(batches):
            shard = Shard(t.column("text"), opened(broadcasts))
            row, start, end = shard.spans()
            text: dict[int, list[str]] = {}
            chars: dict[int, np.ndarray] = {}
            for r, s, e in zip(row.tolist(), start.tolist(), end.tolist()):
                if r not in chars:
                    chars = {r: char_positions(shard.data[shard.offsets[r] : shard.offsets[r + 1]])}
                base = shard.offsets[r]
                text.setdefault(r, []).append(f"{chars[r][s - base]}:{chars[r][e - base]}")
            found = [sorted(map(str, shard.items.get(r, ()))) for r in range(shard.n_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    t.column("doc_id").combine_chunks(),
                    pa.array(shard.n_words.astype(np.int64)),
                    pa.array(shard.n_hit.astype(np.int64)),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([hashlib.sha256(",".join(f).encode()).hexdigest() for f in found], pa.string()),
                    pa.array(shard.contaminated),
                    pa.array([",".join(text.get(r, ())) for r in range(shard.n_rows)], pa.string()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    return run


def removals(broadcasts):
    """Rows that stay: contaminated documents go, shorter hits are cut out of the text."""

    def run(batches):
        for t in shard_tables(batches):
            shard = Shard(t.column("text"), opened(broadcasts))
            row, start, end = shard.spans()
            cut: dict[int, bytes] = {}
            for r in np.unique(row).tolist():
                if not shard.contaminated[r]:
                    at, parts = shard.offsets[r], []
                    for s, e in zip(start[row == r].tolist(), end[row == r].tolist()):
                        parts.append(shard.data[at:s].tobytes())
                        at = e
                    cut[r] = b"".join([*parts, shard.data[at : shard.offsets[r + 1]].tobytes()])
            if cut:
                texts = t.column("text").to_pylist()
                for r, b in cut.items():
                    texts[r] = b.decode("utf-8", "replace")
                t = t.set_column(t.schema.get_field_index("text"), t.schema.field("text"), pa.chunked_array([pa.array(texts, t.schema.field("text").type)]))
                if "n_chars" in t.column_names:
                    sizes = t.column("n_chars").to_pylist()
                    for r in cut:
                        sizes[r] = len(texts[r])
                    t = t.set_column(t.schema.get_field_index("n_chars"), t.schema.field("n_chars"), pa.chunked_array([pa.array(sizes, t.schema.field("n_chars").type)]))
            yield from t.filter(pa.array(~shard.contaminated)).to_batches()

    return run


def benchmark_blocks(benchmark: DataFrame, block: int = BLOCK) -> list:
    """Broadcasts of :func:`window_arrays`, each of about ``block`` bytes of text; the benchmark is read once."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("text"))
    total = items.agg(F.sum(F.length("text") + F.coalesce(F.length("item"), F.lit(0)))).first()[0] or 0
    n = max(1, math.ceil(total / block))
    out, held, size = [], [], 0
    # Partitions of about a block each come one after the other; a block is passed on as soon as it is full.
    for r in items.repartition(n).toLocalIterator():
        held.append((r.item, bytes(r.text)))
        size += len(r.text)
        if size >= block:
            out.append(spark.sparkContext.broadcast(window_arrays(held)))
            held, size = [], 0
    if held or not out:
        out.append(spark.sparkContext.broadcast(window_arrays(held)))
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each document: counts, items and merged removal spans (code points)."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.transform(mapped, scores(benchmark_blocks(benchmark, block)), SCHEMA)


def remove_benchmark(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without contaminated ones and without hit passages; same columns."""
    return documents.transform(mapped, removals(benchmark_blocks(benchmark)), documents.schema)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
