"""A conversion from file to file: scan, validate, write, check totals, report."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from typing import TextIO

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from flatspark.operators.rules import Report, check, judge, observed
from flatspark.operators.validate import diagnostics, rejects, validate
from flatspark.plans.layout import Layout
from flatspark.sinks.text import TEXT, sql_head, write_distributed, write_single
from flatspark.sources.flat import scan
from flatspark.sources.framed import PLUGINS


@dataclass(frozen=True)
class Conversion:
    report: Report
    validated: DataFrame

    def rejects(self) -> DataFrame:
        return rejects(self.validated)


def convert(spark: SparkSession, source: str, layout: Layout, fmt: str, output: str | None, plugins_dir: str = PLUGINS, verbose: TextIO | None = None, stdout: TextIO | None = None) -> Conversion:
    """Converts one file; without ``output`` only validates. Output ``-`` goes to ``stdout``.

    The validated frame is kept on disk or in memory between the totals and the sink, so files are read once.
    """
    if fmt == "sql" and output is not None:
        sql_head(layout)
    validated = validate(scan(spark, source, layout, plugins_dir), layout).persist(StorageLevel.MEMORY_AND_DISK)
    report = check(validated, layout)  # also ends the run at a byte that cannot be decoded
    if verbose is not None:
        for r in diagnostics(validated).orderBy("line").toLocalIterator():
            print(r.text, file=verbose)
    if output == "-" and fmt in TEXT:
        write_single(validated, layout, fmt, output, stdout or sys.stdout)
    elif output is not None:
        write_single(validated, layout, fmt, output)
    return Conversion(report, validated)


def convert_distributed(spark: SparkSession, source: str | list[str], layout: Layout, fmt: str, folder: str, plugins_dir: str = PLUGINS, mode: str = "errorifexists") -> Report:
    """Converts files of any size into a folder of part files; counts and totals come from the job that writes."""
    validated, seen = observed(validate(scan(spark, source, layout, plugins_dir), layout), layout)
    write_distributed(validated, layout, fmt, folder, mode)
    return judge(layout, seen.get)
