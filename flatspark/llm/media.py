"""Media columns: texts as lossless WebP images, and what is computed from their pixels.

A payload is the UTF-8 bytes of a text with zero bytes up to a positive multiple of 64. A byte makes a
grey pixel; rows have 64 pixels, or as many times 64 as keep the height within the format's 16,384, the
last row filled with zeros. ``to_media`` writes files, ``pixels_of`` decodes files of any kind to arrays,
``features`` joins both. Each file has prefix codes of its own. Texts of few values get a palette with
several pixels in one; of the others a third each has back-references after the subtraction of green, a
predictor and a colour cache, and the cross-colour transform with references and cache (webp.py).

Texts pass in slices of about 64 kB, their files in groups of about half a megabyte, a longer one alone;
nothing is shuffled or gathered.

Defined results: a null or empty text has 64 zero bytes as its payload; equal texts have equal values;
repeated rows give repeated results; bytes that are no lossless WebP give null pixels; a text over the
format's limit of 256 MiB fails; an empty table gives an empty result; other columns do not matter.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table
from .textops import slices, text_buffer
from .webp import FormatError, channels, decode, decode_all, encode_grey

UNIT = 64
TALLEST = 1 << 14
#: Bytes of texts that are written together, about.
WRITTEN = 1 << 16
#: Bytes of files and their texts that are read together, about.
READ = 1 << 19


def payload_size(n_bytes: int) -> int:
    return max(1, -(-n_bytes // UNIT)) * UNIT


def shape(n_bytes: int) -> tuple[int, int]:
    """Height and width of the image of a text."""
    rows = payload_size(n_bytes) // UNIT
    wide = -(-rows // TALLEST)
    if wide * UNIT > TALLEST:
        raise ValueError(f"a text of {n_bytes} bytes is over the limit of the format")
    return -(-rows // wide), wide * UNIT


def write_media(batches):
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for lo, hi in slices(offsets, WRITTEN):
            sizes = np.diff(offsets[lo : hi + 1])
            shapes = [shape(n) for n in sizes.tolist()]
            bounds = np.concatenate([[0], np.cumsum([h * w for h, w in shapes], dtype=np.int64)])
            padded = np.zeros(bounds[-1], dtype=np.uint8)
            padded[np.arange(offsets[hi] - offsets[lo]) + np.repeat(bounds[:-1] - (offsets[lo:hi] - offsets[lo]), sizes)] = data[offsets[lo] : offsets[hi]]
            files = encode_grey(padded, bounds, [w for _, w in shapes])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(sizes), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])


def decoded(batch):
    """n_bytes, file and pixels of each row; files are decoded in groups of about ``READ`` bytes with their texts."""
    sizes = batch.column("n_bytes").to_numpy()
    _, ends = text_buffer(batch.column("media"))
    for lo, hi in slices(ends + np.append(0, np.cumsum(sizes)), READ):
        files = batch.column("media").slice(lo, hi - lo).to_pylist()
        yield from zip(sizes[lo:hi].tolist(), files, decode_all(files))


def read_features(batches):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        out: list[list] = [[] for _ in names[2:]]
        for n, media, pixels in decoded(batch):
            payload = channels(pixels)[..., 1].reshape(-1)[: payload_size(n)]
            raw = payload.tobytes()
            sums = payload.reshape(-1, 4).sum(axis=0, dtype=np.int64).tolist()
            row = len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), f"{pixels.shape[1]}x{pixels.shape[0]}:" + ",".join(map(str, sums)) + f":{int(payload.max())}"
            for column, value in zip(out, row):
                column.append(value)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(out, kinds))], names=names)


def read_pixels(batches):
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64())]
    for batch in batches:
        rows = []
        for media in batch.column("media").to_pylist():
            try:
                pixels = decode(media or b"")
                rows.append((pixels.shape[1], pixels.shape[0], pixels.ravel().astype(np.int64)))
            except FormatError:
                rows.append((None, None, None))
        yield pa.RecordBatch.from_arrays([batch.column("media_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["media_id", "width", "height", "argb"])


def to_media(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the file of each text."""
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(mapped, write_media, "doc_id long, n_bytes long, media binary")


def pixels_of(media: DataFrame, key: str, column: str) -> DataFrame:
    """media_id, width, height and ARGB numbers, row by row, of each file; nulls for other bytes."""
    return media.select(F.col(key).cast("long").alias("media_id"), F.col(column).cast("binary").alias("media")).transform(mapped, read_pixels, "media_id long, width int, height int, argb array<long>")


def features(documents: DataFrame) -> DataFrame:
    """Writes each text as a file, reads it back and computes digests and channel sums."""
    return to_media(documents).transform(mapped, read_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(table(spark, sf_dir, "documents"))
