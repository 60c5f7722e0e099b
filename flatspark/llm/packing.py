"""Packing with optimal length buckets.

A length is the number of words ``[^\\x20\\x09-\\x0D]+`` of a text and one for its end. The lengths of all
documents are counted by groupBy; dynamic programming over this histogram chooses the ``buckets`` upper
bounds with the least padded tokens. A bucket's documents, by length and then id (null ids last), fill batches of
``budget // bound`` rows (one row if the bound is over the budget), so a batch has at most ``budget``
padded tokens.

The driver gets one row for each distinct length; D distinct lengths need at least D * (D + 1) / 2
tokens, so there are at most the square root of twice the tokens of the corpus (about 7 million at 100
TB of text). Texts never move. Places in a bucket come from counts by blocks of at most ``BLOCK``
rows, however many rows a bucket has, so no task holds a bucket.

Defined results: a null or empty text has length 1; repeated rows take a place each, and the files' layout does not matter; fewer distinct
lengths than buckets give as many buckets as lengths; an empty table gives an empty result; other
columns of the input do not matter.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW_BITS, checkpoint, table

BUCKETS = 12
BUDGET = 1 << 16
BLOCK = 4096


def optimal_bounds(lengths, counts, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds, ascending, that minimise the sum of count * bound; the last is the longest length.

    The best cost for the first j lengths in k buckets is min over i of cost[k-1][i] + L[j] * (C[j] - C[i]):
    for each i a line in L[j] of slope -C[i]. Slopes fall and queries grow, so each layer is one walk along
    the lower hull of its lines. Of equal costs the first i wins. Numbers are exact.
    """
    order = np.argsort(lengths)
    size = np.asarray(lengths, dtype=np.int64)[order].tolist()
    total = [0, *np.cumsum(np.asarray(counts, dtype=np.int64)[order]).tolist()]
    n = len(size)
    if not n:
        return []
    cost = [0] + [size[j - 1] * total[j] for j in range(1, n + 1)]
    back = [np.zeros(n + 1, dtype=np.int32)]
    for k in range(2, min(buckets, n) + 1):
        hull: list[int] = []
        at, new, link = 0, [0] * (n + 1), np.zeros(n + 1, dtype=np.int32)
        for j in range(k, n + 1):
            i = j - 1
            while len(hull) - at >= 2:
                a, b = hull[-2], hull[-1]
                # b is never below both a and i
                if (cost[i] - cost[a]) * (total[b] - total[a]) <= (cost[b] - cost[a]) * (total[i] - total[a]):
                    hull.pop()
                else:
                    break
            hull.append(i)
            x = size[j - 1]
            while at + 1 < len(hull) and cost[hull[at + 1]] - x * total[hull[at + 1]] < cost[hull[at]] - x * total[hull[at]]:
                at += 1
            link[j] = hull[at]
            new[j] = cost[hull[at]] + x * (total[j] - total[hull[at]])
        cost = new
        back.append(link)
    out, j = [], n
    for link in reversed(back):
        out.append(size[j - 1])
        j = int(link[j])
    return out[::-1]


def with_lengths(documents: DataFrame) -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return documents.select(F.col("doc_id").cast("long"), (words + 1).cast("long").alias("n_tokens"))


def histogram(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow()
    return got.column("n_tokens").to_numpy(), got.column("n").to_numpy()


def pack(documents: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, pad_to, batch (within the bucket) and slot (within the batch)."""
    rows = checkpoint(with_lengths(documents))
    bounds = optimal_bounds(*histogram(rows), buckets)
    # Numbered in their order and written once: numbers must be the same in the counts and in the places.
    rows = checkpoint(rows.orderBy("n_tokens", F.asc_nulls_last("doc_id")).withColumn("uid", F.monotonically_increasing_id()))
    known = F.array(*map(F.lit, bounds)) if bounds else F.array(F.lit(1))
    low = F.col("uid").bitwiseAND((1 << ROW_BITS) - 1)
    placed = rows.withColumns(
        {"bucket": F.size(F.filter(known, lambda b: b < F.col("n_tokens"))), "part": F.shiftright("uid", ROW_BITS), "block": F.floor(low / BLOCK)},
    )
    sizes = placed.groupBy("bucket", "part", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", "part", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket", "part", "block").orderBy("uid")
    numbered = placed.withColumn("place", F.row_number().over(inside) - 1).join(starts, ["bucket", "part", "block"])
    pad_to = F.element_at(known, F.col("bucket") + 1).cast("long")
    return (
        numbered.withColumn("pad_to", pad_to)
        .withColumn("place", F.col("place") + F.col("start"))
        .withColumn("rows", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("pad_to"))))
        .select("doc_id", "n_tokens", "bucket", "pad_to", F.floor(F.col("place") / F.col("rows")).cast("long").alias("batch"), (F.col("place") % F.col("rows")).cast("long").alias("slot"))
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
