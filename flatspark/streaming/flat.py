"""The same validation over files that arrive: a stateless stream of validated records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flatspark.operators.validate import validate
from flatspark.plans.layout import Layout
from flatspark.sources.lines import trimmed


def stream_flat(spark: SparkSession, folder: str, layout: Layout, **how) -> DataFrame:
    """Validated frame of a folder's files as they come. Lines have no number (it is null): a split is read alone.

    A layout with a header is not streamed, as a header can only be told by its line number.
    """
    if layout.has_header or layout.parser:
        raise ValueError("a layout with a header or a plugin cannot be streamed")
    raw = spark.readStream.option("lineSep", "\n").text(folder)
    records = raw.select(F.col("_metadata.file_path").alias("source"), F.lit(None).cast("bigint").alias("line"), trimmed(F.col("value").cast("binary")).alias("record"))
    return validate(records.where(F.length("record") > 0), layout, **how)
