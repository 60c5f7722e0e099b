"""Near duplicates by DartMinHash signatures and a banded join, verified exactly.

A document is the multiset of its shingles of five consecutive words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
lower-casing A-Z; a shorter document has one shingle of all its words). An element of weight w is a
region of w unit cells. Darts fall on a cell by a hashed Poisson process in the direction of the rank:
each has a rank, a coordinate of the signature and an identity that depend on the cell alone. A
document takes the darts on its cells up to rank t / W, W being its weight, so about t darts whatever
its size, and keeps the earliest of each coordinate; if one stays empty, the rank doubles. Two
signatures agree in a coordinate with a probability of their weighted Jaccard similarity.

Copies of a text are one class from the start. Signatures of distinct texts are joined by ``BANDS`` bands
of ``ROWS`` coordinates: two texts of similarity 0.8 miss each other in all of them with probability
3e-6. Within a bucket each text is paired with the most central one, that whose buckets hold the most
texts: the original of edited copies, say. Pairs whose sizes or signatures rule out 0.8 go (the limit
lies five deviations below); the others are compared by all their shingles. Links give components by
large-star and small-star steps. Texts outside the largest component of a bucket are then compared
with all texts of the bucket's other components, so that each pair in a bucket is in one component or
has been compared. This is done in blocks of about ``BLOCK`` shingles by matrix products: a task holds two
blocks, and no pair is emitted that is not a link. Its work grows with the texts left over times the
bucket, which is much only where many texts are close to each other but not similar.

Texts move once, those of texts that share a bucket; keys with very many rows are met in joins whose
skewed side Spark splits, and counts are summed before they move.

Defined results: a null text counts as the empty one, and texts without words are alike only if equal;
class_id is the least id of the class (null ids last); repeated rows each get a row; an empty table
gives an empty result; other columns of the input do not matter.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, fresh, mapped, row_keys, table
from .textops import ALNUM, Tokenizer, mix, slices, text_buffer

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
#: Expected darts of a document; a coordinate stays empty in one of twelve documents, which then take more.
DARTS = COORDINATES * (math.log(COORDINATES) + 2.5)
#: Equal coordinates, below which a pair is not compared: 0.8 less five standard deviations.
AGREE = math.floor(COORDINATES * SIMILAR - 5 * math.sqrt(COORDINATES * SIMILAR * (1 - SIMILAR)))
#: Shingles of a block, about.
BLOCK = 200_000
#: Columns of a matrix product.
COLUMNS = 2048


def cells(words, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each unit cell: the j-th occurrence of a shingle in a row is a cell of its own."""
    h, row = words.hash, words.row
    n = len(h)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(SHINGLE):
        key[: n - j] += h[j:] * np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64))
    whole = np.zeros(n, dtype=bool)
    if n >= SHINGLE:
        whole[: n - SHINGLE + 1] = row[: n - SHINGLE + 1] == row[SHINGLE - 1 :]
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    extra = np.array([int(sum(int(x) * pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64) for j, x in enumerate(h[words.bounds[r] : words.bounds[r + 1]]))) & ((1 << 64) - 1) for r in short.tolist()], dtype=np.uint64)
    row = np.concatenate([row[whole], short])
    key = mix(np.concatenate([key[whole], extra ^ np.uint64(0x5851F42D4C957F2D)]))
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    start = np.flatnonzero(first)
    again = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    return row, mix(key + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def waits(x: np.ndarray) -> np.ndarray:
    """Exponential waiting times from hashes."""
    return -np.log1p(-((x >> np.uint64(11)).astype(np.float64) * 2.0**-53))


def signatures(row: np.ndarray, cell: np.ndarray, n_rows: int, darts: float = DARTS) -> np.ndarray:
    """(rows, COORDINATES) identities of the earliest darts; rows without cells have zeros."""
    out = np.zeros((n_rows, COORDINATES), dtype=np.uint32)
    weight = np.bincount(row, minlength=n_rows)
    todo = np.flatnonzero(weight > 0)
    limit = darts / np.maximum(weight, 1)
    while len(todo):
        at = np.full(n_rows, -1)
        at[todo] = np.arange(len(todo))
        own = at[row] >= 0
        r, c = at[row[own]], cell[own]
        stop = limit[todo][r]
        rank, number = np.zeros(len(r)), 0
        places, ranks, names = [], [], []
        while len(r):
            number += 1
            x = mix(c + np.uint64(number * 0xD1342543DE82EF95 & (1 << 64) - 1))
            rank = rank + waits(x)
            live = np.flatnonzero(rank <= stop)
            r, c, stop, rank, x = r[live], c[live], stop[live], rank[live], mix(x[live] ^ np.uint64(0xA24BAED4963EE407))
            places.append(r * COORDINATES + ((x >> np.uint64(32)) * np.uint64(COORDINATES) >> np.uint64(32)).astype(np.int64))
            ranks.append(rank)
            names.append((x & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        place, name = np.concatenate(places), np.concatenate(names)
        late_first = np.argsort(-np.concatenate(ranks), kind="stable")
        best = np.zeros(len(todo) * COORDINATES, dtype=np.uint32)
        full = np.zeros(len(todo) * COORDINATES, dtype=bool)
        best[place[late_first]] = name[late_first]  # of several at a place, the earliest is written last
        full[place] = True
        done = full.reshape(-1, COORDINATES).all(axis=1)
        out[todo[done]] = best.reshape(-1, COORDINATES)[done]
        todo = todo[~done]
        limit[todo] *= 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(rows, BANDS) 64-bit keys."""
    parts = signature.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(ROWS):
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + parts[:, :, j])
    return out


def signed(batches):
    task, done, tokenize = TaskContext.get().partitionId(), 0, Tokenizer(ALNUM)
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for lo, hi in slices(offsets):
            n = hi - lo
            own = offsets[lo : hi + 1]
            row, cell = cells(tokenize(data[own[0] : own[-1]], own), n)
            weight = np.bincount(row, minlength=n)
            signature = signatures(row, cell, n)
            bands = band_keys(signature)
            bounds = np.concatenate([[0], np.cumsum(np.where(weight > 0, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    row_keys(task, done, n),
                    batch.column("doc_id").slice(lo, n),
                    pa.array([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(own[:-1], own[1:])], pa.binary()),
                    pa.array(weight.astype(np.int64)),
                    pa.array([s.tobytes() for s in signature.astype(np.uint8)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(bands[weight > 0].ravel().view(np.int64))),
                ],
                names=["uid", "doc_id", "tid", "weight", "sig", "bands"],
            )
            done += n


def shingled(batches):
    """The cells of a text as sorted 32-bit numbers."""
    tokenize = Tokenizer(ALNUM)
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for lo, hi in slices(offsets):
            own = offsets[lo : hi + 1]
            row, cell = cells(tokenize(data[own[0] : own[-1]], own), hi - lo)
            bounds = np.searchsorted(row, np.arange(hi - lo + 1))
            small = (cell >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column("uid").slice(lo, hi - lo), pa.array([np.sort(small[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], names=["uid", "cells"])


def digests(batches):
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        ids = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), batch.column("text")], names=["tid", "text"])


def likely(batches):
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        if len(batch):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= AGREE))


def compared(batches):
    """Pairs of a weighted Jaccard similarity of SIMILAR or more."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("cells_a"), batch.column("cells_b")):
            x, y = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            # Numbers that one text has twice by chance count at most as often as the other has them.
            same = int((both[1:] == both[:-1]).sum()) - (len(x) - len(np.unique(x))) - (len(y) - len(np.unique(y)))
            keep.append(same >= SIMILAR * (len(x) + len(y) - same))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the least node of its component) of all nodes of edges (a, b)."""
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = checkpoint(large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct())
        state = tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def similar(pairs: DataFrame, reps: DataFrame, shingles: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar."""
    for c in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("uid").alias(c), F.col("sig").alias(f"sig_{c}")), c)
    pairs = pairs.transform(mapped, likely, "a long, b long")
    for c in ("a", "b"):
        pairs = pairs.join(shingles.select(F.col("uid").alias(c), F.col("cells").alias(f"cells_{c}")), c)
    return pairs.transform(mapped, compared, "a long, b long")


def shared(asking: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """(asking, others) numbers of common cells."""
    out = np.zeros((len(asking), len(others)), dtype=np.float32)
    known, column = np.unique(np.concatenate([*asking, *others]), return_inverse=True)
    row = np.repeat(np.arange(len(asking) + len(others)), [len(x) for x in [*asking, *others]])
    column = column[np.argsort(column, kind="stable")], row[np.argsort(column, kind="stable")]
    often = np.bincount(column[0], minlength=len(known)) > 1
    place = np.cumsum(often) - 1
    keep = often[column[0]]
    column, row = place[column[0][keep]], column[1][keep]
    for lo in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((len(asking) + len(others), COLUMNS), dtype=np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        out += part[: len(asking)] @ part[len(asking) :].T
    return out


def block_links(rows: list[tuple]):
    """Links between components among (uid, comp, asks, cells); one for each two components."""
    asking, others = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    if not asking or not others:
        return []
    cells_a, cells_b = ([np.frombuffer(r[3], np.uint32) for r in side] for side in (asking, others))
    size_a, size_b = (np.array([len(c) for c in side], dtype=np.float32) for side in (cells_a, cells_b))
    same = shared(cells_a, cells_b)
    like = same >= np.float32(SIMILAR) * (size_a[:, None] + size_b - same) - np.float32(1e-3)
    found = {}
    for i, j in np.argwhere(like).tolist():
        if asking[i][1] != others[j][1]:
            found.setdefault((asking[i][1], others[j][1]), (asking[i][0], others[j][0]))
    return list(found.values())


def linked(batches):
    """Rows come by bucket and pair of blocks; gives the links of each pair of blocks."""
    current, rows = None, []
    for batch in batches:
        found = []
        for r in zip(*(batch.column(c).to_pylist() for c in ("key", "ask_block", "block", "uid", "comp", "asks", "cells"))):
            if r[:3] != current:
                found += block_links(rows)
                current, rows = r[:3], []
            rows.append(r[3:])
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
    found = block_links(rows)
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def links_left(placed: DataFrame, shingles: DataFrame) -> DataFrame:
    """Links (a, b) between components of the same bucket (key, uid, weight, comp)."""
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "comp", "w")).alias("top"), F.sum("w").alias("w"), F.count("*").alias("k")).where("k > 1")
    blocks = lambda w: F.ceil(w / F.lit(BLOCK)).cast("int")
    main = main.select("key", F.col("top.comp").alias("main"), blocks(F.col("w") - F.col("top.w")).alias("ask_blocks"), blocks(F.col("w")).alias("blocks"))
    rows = placed.join(main, "key").join(shingles, "uid")
    place = lambda n: F.pmod(F.xxhash64("uid"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["key", "uid", "comp", "cells"]
    asking = rows.where("comp != main").select(*columns, F.lit(True).alias("asks"), place(F.col("ask_blocks")).alias("ask_block"), every(F.col("blocks")).alias("block"))
    others = rows.select(*columns, F.lit(False).alias("asks"), place(F.col("blocks")).alias("block"), every(F.col("ask_blocks")).alias("ask_block"))
    by = ["key", "ask_block", "block"]
    return asking.unionByName(others).repartition(*by).sortWithinPartitions(*by).transform(mapped, linked, "a long, b long")


def classed(documents: DataFrame) -> DataFrame:
    """doc_id, tid (digest of the text) and class of each document."""
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = checkpoint(docs.transform(mapped, signed, "uid long, doc_id long, tid binary, weight long, sig binary, bands array<long>"))
    first = rows.groupBy("tid").agg(F.min("uid").alias("rep"))
    known = rows.select("doc_id", "tid").join(first, "tid").select("doc_id", "tid", "rep")
    reps = rows.join(first.select(F.col("rep").alias("uid")), "uid", "left_semi")

    banded = reps.select("uid", "weight", F.explode("bands").alias("key"))
    counts = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = checkpoint(banded.join(counts, "key"))
    central = crowded.join(crowded.groupBy("uid").agg(F.sum("n").alias("near")), "uid")
    leaders = central.groupBy("key").agg(F.max(F.struct("near", (-F.col("uid")).alias("neg"), "weight")).alias("top")).select("key", (-F.col("top.neg")).alias("leader"), F.col("top.weight").alias("leader_weight"))
    members = crowded.drop("n").join(leaders, "key")
    near_size = lambda x, y: F.least(x, y) >= SIMILAR * F.greatest(x, y)

    # Shingles of the texts that share a bucket; the texts are found by their digest.
    wanted = reps.select("uid", "tid").join(crowded.select("uid").distinct(), "uid", "left_semi")
    texts = docs.select("text").transform(mapped, digests, "tid binary, text string").join(wanted, "tid").select("uid", "text")
    shingles = checkpoint(texts.transform(mapped, shingled, "uid long, cells binary").groupBy("uid").agg(F.first("cells").alias("cells")))

    stars = members.where((F.col("uid") != F.col("leader")) & near_size(F.col("weight"), F.col("leader_weight"))).select(F.col("leader").alias("a"), F.col("uid").alias("b")).distinct()
    links = checkpoint(similar(stars, reps, shingles))
    parts = components(links)
    placed = crowded.join(parts.select(F.col("node").alias("uid"), "comp"), "uid", "left").select("key", "uid", "weight", F.coalesce("comp", "uid").alias("comp"))
    parts = components(links.unionByName(links_left(placed, shingles)))

    return known.join(parts.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("doc_id", "tid", F.coalesce("comp", "rep").alias("class"))


def near_classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id and class_size of each document."""
    rows = classed(documents)
    heads = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(heads, "class").select("doc_id", "class_id", "class_size")


def with_digest(name: str):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            ids = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, name])

    return run


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each class; same columns.

    The least id stays (null ids last), of several texts under it the one of the least digest, and of
    rows with that id and text any one. Rows are known by id and text, not by id alone. A null text counts
    as the empty one, and empty texts are copies of each other.
    """
    rows = classed(documents)
    heads = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tid")).alias("head"))
    stays = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("tid") == F.col("head.tid"))
    tid, id_of, of = (fresh(documents, n) for n in ("tid", "id_of", "of"))
    keys = rows.join(heads, "class").groupBy(F.col("doc_id").alias(id_of), F.col("tid").alias(of)).agg(F.bool_or(stays).alias("stays"), F.count("*").alias("n"))
    keys = checkpoint(keys.where("NOT stays OR n > 1"))
    marked = documents.transform(mapped, with_digest(tid), T.StructType([*documents.schema.fields, T.StructField(tid, T.BinaryType())]))
    same = marked["doc_id"].cast("long").eqNullSafe(keys[id_of]) & (marked[tid] == keys[of])
    out = marked.join(keys, same, "left_anti").select(documents.columns)
    again = keys.where("stays")
    if again.take(1):
        same = marked["doc_id"].cast("long").eqNullSafe(again[id_of]) & (marked[tid] == again[of])
        out = out.unionByName(marked.join(again, same, "left_semi").dropDuplicates(["doc_id", tid]).select(documents.columns))
    return out


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
