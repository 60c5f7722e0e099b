"""Language-model scores by prediction by partial matching, beside a smoothed unigram base.

Texts are lower-cased (A-Z). The model is a byte trie of order ``ORDER`` (ppm.py) over all training
documents, those whose crc32(doc_id as text) mod 10 is not 0. One pass over the training texts counts
words and byte strings within each task; one shuffle sums both. The order is the same at every size.
A trie of at most ``NODES`` strings goes to the executors as arrays. A larger one is cut into ranges of
contexts, in the order of their bytes from the nearest on, of at most ``NODES`` strings each; the few
lower contexts that a bound cuts are summed over all training texts (see ppm.py). The ranges are
broadcast one after the other: each scores its strings of all documents in a pass of its own, and the
passes' scores are summed by document. The texts are checkpointed for that, so rows keep their keys.

The base needs the training count of each token. Words with at least T occurrences are broadcast,
T being the least power of two that leaves at most ``HEAVY`` of them; all other words of the documents
are joined with the counts by their hash, and their terms are summed by document. Words are known by
64-bit hashes.

Defined results: a null or empty text is only its end (one token); a null id counts as the empty text
for the split; repeated rows and ids give a row each; without training documents N, V and the counts
are 0; an empty table gives an empty result; other columns of the input do not matter.
"""

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, fold, mapped, row_keys, table
from .ppm import Trie, framed, grams, symbol_rows, turned
from .textops import LOWER, NON_SPACE, Tokenizer, slices, text_buffer

ORDER = 5
NODES = 5_500_000
HEAVY = 1_000_000
HELD_OUT = 10
WORD, GRAM = 0, 1
#: Rows that a task counts up before it passes them on.
PENDING = 1_500_000


class Counter:
    """Sums counts of 64-bit keys; passes them on when there are many."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, keys: np.ndarray):
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.parts.append((keys[first], np.diff(np.append(first, len(keys)))))
        self.size += len(first)
        if self.size > PENDING:
            self.merge()
            if self.size > PENDING // 2:
                yield from self.flush()

    def merge(self) -> None:
        keys, counts = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.parts = [(keys[first], np.add.reduceat(counts, first) if len(first) else counts)]
        self.size = len(first)

    def flush(self):
        if self.parts:
            self.merge()
            keys, counts = self.parts[0]
            for i in range(0, len(keys), 100_000):
                k = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), self.kind, np.int8)), pa.array(k.view(np.int64)), pa.array(counts[i : i + 100_000].astype(np.int64))], names=["kind", "key", "n"])
            self.parts, self.size = [], 0


def counts_of(order: int):
    def run(batches):
        words, strings, tokenize = Counter(WORD), Counter(GRAM), Tokenizer(NON_SPACE)
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for lo, hi in slices(offsets):
                part, own = LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1]
                yield from words.add(tokenize(part, own).hash)
                buffer, begin, end = framed(part, own, order)
                yield from strings.add(grams(buffer, order)[symbol_rows(begin, end, order)])
        yield from words.flush()
        yield from strings.flush()

    return run


def built(trie, order: int) -> Trie:
    if not hasattr(trie, "_built"):
        keys, counts, edges = trie.value
        trie._built = Trie(keys, counts, order, edges).ready()
        trie.__dict__.pop("_value", None)
    return trie._built


def text_scores(model: Trie, part: np.ndarray, own: np.ndarray, order: int, span: tuple[int, int] | None) -> np.ndarray:
    """The score of each text, or the share of it that the strings of a range of contexts have."""
    buffer, begin, end = framed(part, own, order)
    strings, mine = grams(buffer, order), symbol_rows(begin, end, order)
    if span:
        context = turned(strings, order)
        at = np.flatnonzero(mine & (context >= np.uint64(span[0])) & (context < np.uint64(span[1])))
        logs = np.zeros(len(strings))
        logs[at] = model.score(strings[at])
    else:
        logs = np.where(mine, model.score(strings), 0.0)
    total = np.concatenate([[0.0], np.cumsum(logs)])
    return total[end - order] - total[begin - order]


def scored_range(trie, order: int, span: tuple[int, int]):
    def run(batches):
        model, task, done = built(trie, order), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for lo, hi in slices(offsets):
                part, own = LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1]
                yield pa.RecordBatch.from_arrays([row_keys(task, done, hi - lo), pa.array(text_scores(model, part, own, order, span))], names=["uid", "more"])
                done += hi - lo

    return run


def scored(trie, heavy, order: int, span: tuple[int, int] | None, divisor: float, n_end: int):
    def run(batches):
        model, (keys, counts) = built(trie, order), heavy.value
        tokenize, task, done = Tokenizer(NON_SPACE), TaskContext.get().partitionId(), 0
        term = np.log10((counts + 0.1) / divisor)
        end_term = math.log10((n_end + 0.1) / divisor)
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for lo, hi in slices(offsets):
                part, own, n = LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1], hi - lo
                w = tokenize(part, own)
                at = np.minimum(np.searchsorted(keys, w.hash), max(len(keys) - 1, 0))
                known = keys[at] == w.hash if len(keys) else np.zeros(len(w.hash), dtype=bool)
                base = np.bincount(w.row[known], weights=term[at[known]], minlength=n) + end_term
                n_known = np.bincount(w.row[known], minlength=n) + (n_end > 0)
                tail = w.hash[~known].view(np.int64)
                bounds = np.concatenate([[0], np.cumsum(np.bincount(w.row[~known], minlength=n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        row_keys(task, done, n),
                        batch.column("doc_id").slice(lo, n),
                        batch.column("held_out").slice(lo, n),
                        pa.array(w.count + 1),
                        pa.array(n_known.astype(np.int64)),
                        pa.array(base),
                        pa.array(text_scores(model, part, own, order, span)),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(tail)),
                    ],
                    names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail"],
                )
                done += n

    return run


def to_arrays(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """Columns of a frame whose size has been checked."""
    got = df.select(*columns).toArrow()
    return [got.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in columns]


def turned_prefix(order: int, size: int):
    """As turned(), of the column ``key``, only the ``size`` nearest bytes."""
    out = F.lit(0).cast("long")
    for j in range(size):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("key", 8 * (j + 1)).bitwiseAND(F.lit(255).cast("long")), 8 * (size - 1 - j)))
    return out


def ranges(strings: DataFrame, order: int, nodes: int) -> list[tuple[int, int]]:
    """Ranges of turned contexts that hold at most ``nodes`` strings each, or else a single context."""
    size = min(2, order)

    def binned(df: DataFrame) -> dict[int, int]:
        return {r.b << 8 * (order - size): r.n for r in df.groupBy(turned_prefix(order, size).alias("b")).agg(F.count("*").alias("n")).collect()}

    bins = binned(strings)
    while size < order and (large := [b for b, n in bins.items() if n > nodes]):
        for b in large:
            del bins[b]
        within = strings.where(turned_prefix(order, size).isin([b >> 8 * (order - size) for b in large]))
        size += 1
        bins |= binned(within)
    bounds, held = [0], 0
    for b in sorted(bins):
        if held and held + bins[b] > nodes:
            bounds.append(b)
            held = 0
        held += bins[b]
    return list(zip(bounds, [*bounds[1:], 1 << 8 * order]))


def cut_contexts(strings: DataFrame, order: int, spans: list[tuple[int, int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By level below the top: strings, with counts over all ranges, of the contexts at the ranges' ends."""
    ends = {e for first, stop in spans for e in (first, stop - 1)}
    out = {}
    for k in range(order):
        cut = strings.where(turned_prefix(order, k).isin(sorted({e >> 8 * (order - k) for e in ends})))
        keys, counts = to_arrays(cut.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1).cast("long")).alias("key")).agg(F.sum("n").alias("n")), "key", "n")
        out[k] = keys.view(np.uint64), counts
    return out


def score_documents(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (fold("doc_id", HELD_OUT) == 0).alias("held_out"))
    train = docs.where("NOT held_out")
    found = checkpoint(train.select("text").transform(mapped, counts_of(order), "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words, strings = (found.where(F.col("kind") == k).select("key", "n") for k in (WORD, GRAM))

    sizes = words.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()
    n_end = train.count()
    n_all = sum(r.n for r in sizes) + n_end
    n_kinds = sum(r.v for r in sizes) + (n_end > 0)
    bits, many = 64, 0
    for r in sorted(sizes, key=lambda r: -r.bits):
        many += r.v
        if many > HEAVY:
            break
        bits = r.bits
    least = 1 << (bits - 1) if sizes else 1
    keys, counts = to_arrays(words.where(F.col("n") >= least), "key", "n")
    keys = keys.view(np.uint64)
    at = np.argsort(keys)
    heavy = spark.sparkContext.broadcast((keys[at], counts[at]))

    spans, edges = [None], None
    if order and strings.count() > NODES:
        spans = ranges(strings, order, NODES)
        edges = cut_contexts(strings, order, spans)
        docs = checkpoint(docs)
    divisor = n_all + 0.1 * (n_kinds + 1)
    rows, more = None, []
    for span in spans:
        own = strings.where(turned_prefix(order, order).between(span[0], span[1] - 1)) if span else strings
        keys, counts = to_arrays(own, "key", "n")
        trie = spark.sparkContext.broadcast((keys.view(np.uint64), counts, edges))
        del keys, counts
        if rows is None:
            rows = checkpoint(docs.transform(mapped, scored(trie, heavy, order, span, divisor, n_end), "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<long>"))
        else:
            more.append(checkpoint(docs.select("text").transform(mapped, scored_range(trie, order, span), "uid long, more double")))
        trie.destroy()
    tail = rows.select("uid", F.explode("tail").alias("key"))
    rare = words.where(F.col("n") < least)
    terms = (
        tail.join(rare, "key", "left")
        .select("uid", F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(divisor)).alias("term"), F.col("n").isNotNull().cast("long").alias("known"))
        .groupBy("uid")
        .agg(F.sum("term").alias("term"), F.sum("known").alias("known"))
    )
    found = rows.drop("tail").join(terms, "uid", "left")
    if more:
        found = found.join(functools.reduce(DataFrame.unionByName, more).groupBy("uid").agg(F.sum("more").alias("more")), "uid").withColumn("score", F.col("score") + F.col("more"))
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("term", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
