"""Evidence of a conversion: digests of input and output, layout and counts."""

from __future__ import annotations

import datetime
import hashlib
import os

import pyarrow.fs as pafs

from flatspark.operators.rules import Report
from flatspark.plans.layout import Layout


def sha256_of(path: str) -> str:
    """Digest of a file, or of a folder's files by name, without Spark's own; a path or the URI of a store."""
    store, where = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))
    found = store.get_file_info(where)
    if found.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no such file: {path}")
    names = [where]
    if found.type == pafs.FileType.Directory:
        names = sorted(f.path for f in store.get_file_info(pafs.FileSelector(where, recursive=True)) if f.is_file and f.base_name[0] not in "._")
    digest = hashlib.sha256()
    for name in names:
        with store.open_input_stream(name, compression=None) as f:
            while block := f.read(1 << 20):
                digest.update(block)
    return digest.hexdigest()


def summary(source: str, output: str, layout: Layout, report: Report) -> list[str]:
    lines = [f"input_sha256={sha256_of(source)}"]
    if output != "-":
        try:
            lines.append(f"output_sha256={sha256_of(output)}")
        except OSError:
            lines.append("output_sha256=unavailable")
    facts = {
        "schema_format": layout.format,
        "schema_version": layout.version,
        "records_total": report.total,
        "records_ok": report.ok,
        "records_errors": report.errors,
        "rule_violations": len(report.violations),
        "utc_timestamp": datetime.datetime.now(datetime.timezone.utc).isoformat(),
    }
    return lines + [f"{k}={v}" for k, v in facts.items()]


def write_sidecar(source: str, output: str, layout: Layout, report: Report) -> str:
    path = output + ".sha256"
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(summary(source, output, layout, report)) + "\n")
    return path
