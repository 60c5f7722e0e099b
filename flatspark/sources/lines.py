"""Byte-exact line scans with physical line numbers.

A record frame has ``source`` (string), ``line`` (1-based, blank lines counted) and ``record`` (binary,
without its line end). Files are split freely: a first pass counts the lines of each split, which gives
each split's first line number, and a second one reads the records. The table of splits is written once
(a checkpoint) and joined as a broadcast while it has fewer than ``SMALL`` rows, some 100 MB. Both passes
read the same splits, cut when the frame is made: settings or executors that change in between do not
cut the files anew.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SMALL = 1_000_000
RECORD_FRAME = "source string, line bigint, record binary"


def trimmed(raw):
    """Without the carriage returns at its end."""
    return F.when(F.endswith(raw, F.lit(b"\r")), F.encode(F.rtrim(F.decode(raw, "ISO-8859-1"), F.lit("\r")), "ISO-8859-1")).otherwise(raw)


def _raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    # Any other separator setting would also cut at lone carriage returns.
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("raw")
    )


def _cut_now(raw: DataFrame) -> DataFrame:
    """The same rows with the splits that the session's settings give now; nothing is read."""
    spark = raw.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(raw._jdf.queryExecution().toRdd(), raw._jdf.schema(), False), spark)


def first_lines(spark: SparkSession, path: str, n: int, filled: bool) -> list[bytes]:
    """The first lines (``filled``: that are not blank) of one file; splits beyond those needed are not read."""
    raw = spark.read.option("lineSep", "\n").text(path).select(trimmed(F.col("value").cast("binary")).alias("record"))
    return [bytes(r.record) for r in (raw.where(F.length("record") > 0) if filled else raw).take(n)]


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint directory, which all executors and the driver share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="flatspark-"))
    return context.getCheckpointDir()


def scan_lines(spark: SparkSession, path: str | list[str], skip_first: bool = False) -> DataFrame:
    """Non-blank lines of one or more files; ``skip_first`` leaves out the first of each file."""
    shared_folder(spark)
    raw = _cut_now(_raw(spark, path))
    filled = F.length(trimmed(F.col("raw"))) > 0
    splits = raw.groupBy("source", "block").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.min(F.when(filled, F.col("id"))).alias("filled_id"))
    file = Window.partitionBy("source").orderBy("block")
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    splits = splits.withColumn("header", F.min(F.col("before") + F.col("filled_id") - F.col("first_id") + 1).over(Window.partitionBy("source")))
    splits = splits.select("source", "block", "first_id", "before", "header").checkpoint()
    if splits.count() < SMALL:
        splits = F.broadcast(splits)
    lines = raw.join(splits, ["source", "block"]).select("source", (F.col("before") + F.col("id") - F.col("first_id") + 1).alias("line"), trimmed(F.col("raw")).alias("record"), "header")
    lines = lines.where(F.length("record") > 0)
    return (lines.where(F.col("line") > F.col("header")) if skip_first else lines).drop("header")


def scan_unnumbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Non-blank lines in one pass, with the ``block`` (start of the split) and a number ``n`` that only orders the lines of a split."""
    raw = _cut_now(_raw(spark, path)).select("source", "block", F.col("id").alias("n"), trimmed(F.col("raw")).alias("record"))
    return raw.where(F.length("record") > 0)


def from_frame(df: DataFrame, record: str, line: str, source: str = "memory") -> DataFrame:
    """A record frame of rows that are in memory or in a table."""
    return df.select(F.lit(source).alias("source"), F.col(line).cast("bigint").alias("line"), F.col(record).cast("binary").alias("record"))
