"""Binary files of length-prefixed frames, and plugin readers.

A file is read by one task, as its frames can only be found in order, a few frames at a time. Files of up
to ``WHOLE`` bytes come through Spark's binary source, which reads any store that Spark knows; larger
ones, which no cell can hold, are opened by the task as streams.
A plugin is a Python module with a class ``Reader(layout, path)`` whose ``records(skip_first)`` yields
(line, bytes); its source text is sent to the executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flatspark.sources.lines import RECORD_FRAME

PLUGINS = os.path.join(os.path.dirname(__file__), "plugins")
BUILT_IN = "length_prefixed_frame"
#: Bytes of a file that comes in one cell.
WHOLE = 1 << 28


class PluginError(ValueError):
    """A plugin that is missing or has no Reader."""


@dataclass(frozen=True)
class Plugin:
    name: str
    path: str


def discover(folder: str = PLUGINS) -> list[Plugin]:
    names = sorted(os.listdir(folder)) if os.path.isdir(folder) else []
    return [Plugin(n.removesuffix(".py"), os.path.join(folder, n)) for n in names if n.endswith(".py") and n[0] != "_"]


def frames(data: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(ordinal, payload) of a stream's frames: two bytes of length, highest first, and as many bytes."""
    at = number = 0
    while head := data.read(2):
        if len(head) < 2:
            raise ValueError(f"truncated length header at offset {at}")
        size = int.from_bytes(head, "big")
        payload = data.read(size)
        if len(payload) < size:
            raise ValueError(f"truncated frame: expected {size} bytes, got {len(payload)}")
        at, number = at + 2 + size, number + 1
        yield number, payload


def _batches(source: str, records, size: int = 10_000):
    lines, payloads = [], []
    for line, record in records:
        if record:
            lines.append(line)
            payloads.append(bytes(record))
        if len(lines) == size:
            yield pa.RecordBatch.from_arrays([pa.array([source] * len(lines)), pa.array(lines, pa.int64()), pa.array(payloads, pa.binary())], names=["source", "line", "record"])
            lines, payloads = [], []
    if lines:
        yield pa.RecordBatch.from_arrays([pa.array([source] * len(lines)), pa.array(lines, pa.int64()), pa.array(payloads, pa.binary())], names=["source", "line", "record"])


def scan_frames(spark: SparkSession, path: str | list[str], skip_first: bool = False) -> DataFrame:
    limit = WHOLE

    def opened(batch):
        if "content" in batch.schema.names:
            yield from ((p, pa.BufferReader(c.as_buffer())) for p, c in zip(batch.column("path").to_pylist(), batch.column("content")))
        else:
            for p in batch.column("path").to_pylist():
                store, name = pafs.FileSystem.from_uri(p.replace("file:/", "file:///", 1) if p.startswith("file:/") and not p.startswith("file://") else p)
                with store.open_input_stream(name, buffer_size=1 << 20) as stream:
                    yield p, stream

    def run(batches):
        for batch in batches:
            for source, stream in opened(batch):
                yield from _batches(source, (f for f in frames(stream) if not (skip_first and f[0] == 1)))

    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= limit).select("path", "content").mapInArrow(run, RECORD_FRAME)
    return small.unionAll(files.where(F.col("length") > limit).select("path").mapInArrow(run, RECORD_FRAME))


def load_reader(name: str, folder: str = PLUGINS) -> str:
    """Source text of a plugin that has a Reader."""
    found = next((p for p in discover(folder) if p.name == name), None)
    if found is None:
        raise PluginError(f"plugin '{name}' not found in {folder}")
    with open(found.path, encoding="utf-8") as f:
        text = f.read()
    _reader(name, text)
    return text


def _reader(name: str, text: str) -> Any:
    space: dict[str, Any] = {"__name__": f"flatspark_plugin_{name}"}
    exec(compile(text, f"{name}.py", "exec"), space)  # noqa: S102  the user's own module
    if "Reader" not in space:
        raise PluginError(f"plugin '{name}': missing 'Reader' class")
    return space["Reader"]


def scan_plugin(spark: SparkSession, path: str | list[str], layout, folder: str = PLUGINS, skip_first: bool = False) -> DataFrame:
    """Records of files that a plugin opens by itself, a task for each; executors must reach the paths."""
    if layout.parser == BUILT_IN and not any(p.name == BUILT_IN for p in discover(folder)):
        if folder == PLUGINS:
            return scan_frames(spark, path, skip_first)
    name, text = layout.parser, load_reader(layout.parser, folder)
    paths = [path] if isinstance(path, str) else path

    def run(batches):
        for batch in batches:
            for source in batch.column("path").to_pylist():
                yield from _batches(source, _reader(name, text)(layout, source).records(skip_first))

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path").mapInArrow(run, RECORD_FRAME)
