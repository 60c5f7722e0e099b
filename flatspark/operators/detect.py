"""Which layout of a library a file has: candidates are scored on its first records."""

from __future__ import annotations

import glob
import os
import sys
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flatspark.operators.validate import validate
from flatspark.plans.layout import LIBRARY, Layout, LayoutError, load_layout
from flatspark.sources.lines import RECORD_FRAME, first_lines

RECORDS = 5
BONUS = 10


@dataclass(frozen=True)
class Detection:
    layout: Layout
    path: str
    score: int


def candidates(folder: str = LIBRARY) -> list[tuple[str, Layout]]:
    out = []
    for path in sorted(glob.glob(os.path.join(folder, "*.yaml"))):
        try:
            out.append((path, load_layout(path)))
        except (OSError, LayoutError) as e:
            print(f"warning: skipping schema {path}: {e}", file=sys.stderr)
    return out


def scores(sample: DataFrame, layouts: list[tuple[str, Layout]]) -> DataFrame:
    """path and score: for each wholly valid record 10 points and one for each field. Sample: a small record frame.

    Only layouts of a length that some record has are tried, as others have no valid record.
    """
    sizes = {r.n for r in sample.selectExpr("length(record) AS n").distinct().collect()}
    each = [
        validate(sample, layout, on_decode_error="record").select(F.lit(path).alias("path"), F.when(F.col("ok"), BONUS + len(layout.fields)).otherwise(0).alias("score"))
        for path, layout in layouts
        if layout.record_length in sizes
    ]
    if not each:
        return sample.sparkSession.createDataFrame([], "path string, score bigint")
    return reduce(DataFrame.unionAll, each).groupBy("path").agg(F.sum("score").alias("score"))


def detect(spark: SparkSession, path: str, folder: str = LIBRARY) -> Detection | None:
    """The best layout, the first by path among equals; None if no record fits any."""
    first = first_lines(spark, path, RECORDS, filled=True)
    if not first:
        return None
    layouts = candidates(folder)
    sample = spark.createDataFrame([(path, i, r) for i, r in enumerate(first, 1)], RECORD_FRAME)
    best = scores(sample, layouts).where("score > 0").orderBy(F.desc("score"), "path").first()
    return Detection(dict(layouts)[best.path], best.path, best.score) if best else None
