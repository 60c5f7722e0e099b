"""Reading flat files: the library's main entry."""

from __future__ import annotations

import glob
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flatspark.operators.detect import detect
from flatspark.operators.validate import validate, values_of
from flatspark.plans.layout import LIBRARY, Layout, load_layout
from flatspark.sources.framed import PLUGINS, scan_plugin
from flatspark.sources.lines import scan_lines


class InvalidRecords(ValueError):
    """The input has records that fail validation."""


def expand(pattern: str) -> list[str]:
    """Files of a local pattern, sorted; a plain path, or a pattern of another file system, as it is."""
    return (any(c in pattern for c in "*?[") and sorted(glob.glob(pattern))) or [pattern]


def scan(spark: SparkSession, path: str | list[str], layout: Layout, plugins_dir: str = PLUGINS, skip_header: bool = True) -> DataFrame:
    """The record frame of files in a layout."""
    skip = bool(layout.has_header) and skip_header
    if layout.parser is not None:
        return scan_plugin(spark, path, layout, plugins_dir, skip)
    return scan_lines(spark, path, skip)


def resolve(spark: SparkSession, path: str, layout: Layout | str | None, formats_dir: str = LIBRARY) -> Layout:
    if isinstance(layout, str):
        return load_layout(layout)
    if layout is not None:
        return layout
    found = detect(spark, path, formats_dir)
    if found is None:
        raise InvalidRecords("no schema matched the input; name one explicitly")
    return found.layout


def read_flat(spark: SparkSession, path: str, layout: Layout | str | None = None, formats_dir: str = LIBRARY, on_error: str = "raise", backend: str = "spark", plugins_dir: str = PLUGINS, **how) -> Any:
    """The valid records of a file or pattern as a DataFrame (lazy), or as pandas or polars.

    ``on_error``: ``raise`` looks for the first invalid record now; ``ignore`` drops invalid ones;
    ``fail_lazily`` fails when the frame is used.
    """
    if backend not in ("spark", "pandas", "polars"):
        raise ValueError(f"unsupported backend: {backend!r}")
    if on_error not in ("raise", "ignore", "fail_lazily"):
        raise ValueError(f"unsupported on_error: {on_error!r}")
    paths = expand(path)
    layout = resolve(spark, paths[0], layout, formats_dir)
    checked = validate(scan(spark, paths, layout, plugins_dir), layout, **how)
    if on_error == "raise":
        first = checked.where("NOT ok").orderBy("source", "line").limit(1).collect()
        if first:
            raise InvalidRecords(f"line {first[0].line}: {'; '.join(first[0].errors)} (use on_error='ignore' to drop invalid records)")
    if on_error == "fail_lazily":
        bad = F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.array_join("errors", "; ")))
        checked = checked.withColumn("ok", F.when(F.col("ok"), F.lit(True)).otherwise(bad.cast("boolean")))
    rows = values_of(checked)
    if backend == "pandas":
        return rows.toPandas()
    if backend == "polars":
        import polars

        return polars.from_arrow(rows.toArrow())
    return rows
