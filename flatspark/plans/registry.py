"""A library of layouts as a table."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession

from flatspark.plans.layout import LayoutError, load_layout

#: Fixed text: the columns of a printed listing.
HEAD = "format                version   len   table             fields source"
COLUMNS = "format string, version string, len string, table string, n_fields int, source string, duplicate_of string, error string"


def entries(folder: str) -> list[tuple]:
    out, seen = [], {}
    for path in sorted(glob.glob(os.path.join(folder, "*.yaml"))):
        try:
            x = load_layout(path)
        except (OSError, LayoutError) as e:
            out.append((None, None, None, None, None, path, None, str(e)))
            continue
        key = x.format, x.version
        out.append((x.format, str(x.version), "n/a" if x.record_length is None else str(x.record_length), x.table or "", len(x.fields), path, seen.get(key), None))
        seen[key] = path
    return out


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each layout of a folder; ``error`` says why one is invalid."""
    return spark.createDataFrame(entries(folder), COLUMNS)


def listing(table: DataFrame) -> DataFrame:
    """source, the text of each valid layout under ``HEAD``, and a note on invalid and repeated ones."""
    note = "CASE WHEN error IS NOT NULL THEN concat('INVALID ', source, ': ', error) WHEN duplicate_of IS NOT NULL THEN concat('duplicate ', format, '@', version, ' (also ', duplicate_of, ')') END"
    row = "concat(rpad(format, greatest(22, length(format)), ' '), rpad(version, greatest(10, length(version)), ' '), rpad(len, greatest(6, length(len)), ' '), rpad(table, greatest(18, length(table)), ' '), rpad(CAST(n_fields AS string), 7, ' '), source)"
    return table.selectExpr("source", f"CASE WHEN error IS NULL THEN {row} END AS text", f"{note} AS note", "error IS NOT NULL AS invalid").orderBy("source")
