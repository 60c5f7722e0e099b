"""WARC archives of pages, and an external merge of their capture indexes.

Each task writes its records to archives of about ``ARCHIVE`` bytes of payload in a shared folder: a
gzip member for each record, so a record can be read alone. Of records with equal payloads of
``REVISIT`` bytes or more the one with the largest id is a ``response``; the others are ``revisit`` records
that name it and have no payload of their own. The archives are then read back, and every value of the
result comes from what was read, not from the table.

Reading an archive gives a capture run: its index lines (URL key, timestamp, place) in order. Runs
are cut at common splitters into ranges, and each range merges the pieces of all runs with a loser
tree, one comparison on each level for a line. Ranges follow one another, so the merged index is in
global order; counts of the ranges before give each line its place, and the place of the first line of
a URL gives the number of a capture in its history. A URL key with very many captures is cut by
timestamp and id like any others.

Defined results: a null url or html counts as empty; a null id is written as empty, stays a response
and comes back as null; equal lines of the index keep the order of their runs; repeated rows are
records each, and of equal payloads under one largest id one is the response and the rest revisit it;
an empty table gives an empty result; other columns of the input do not matter.
"""

import datetime
import gzip
import hashlib
import io
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, mapped, shared_dir, table

ARCHIVE = 8 << 20
REVISIT = 1000
#: Index lines of a range, about, while there are no more than ``RANGES`` of them; ranges of a larger index hold more.
RANGE = 20_000
RANGES = 20_000
START = datetime.datetime(2020, 1, 1, tzinfo=datetime.timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "urlkey string, timestamp string, id long, archive string, offset long, size long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, timestamp string, urlkey string, archive string, offset long, size long"


def record(kind: str, page: int | None, url: str, time: str, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """A WARC 1.1 record; a revisit keeps its payload's digest and size but not the payload."""
    revisit = kind == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    safe = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page}|{url}|{time}|{digest}|{kind}'.encode()).digest())}>",
        f"WARC-Date: {time}",
        f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page is None else page}",
        *([f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveError(ValueError):
    """Bytes that are no archive of records."""


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ArchiveError("a record does not begin with its version")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(headers["Content-Length"])
    if len(rest) < size + 4 or rest[size : size + 4] != b"\r\n\r\n":
        raise ArchiveError("a record ends early")
    return headers, rest[:size]


def members(data: bytes, step: int = 1 << 15):
    """(offset, size, bytes) of each gzip member."""
    at = 0
    while at < len(data):
        one, out, end = zlib.decompressobj(31), [], at
        while not one.eof:
            if end >= len(data):
                raise ArchiveError("a gzip member ends early")
            out.append(one.decompress(data[end : end + step]))
            end = min(end + step, len(data))
        end -= len(one.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def surt(url: str) -> str:
    """The URL as a sort key: host labels from the last, then port, path and query, in lower case."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip().lower()
    labels = host.split(".")
    if labels[0] == "www":
        labels = labels[1:]
    key = ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/")
    return (key + (f"?{parts.query}" if parts.query else "")).lower()


class LoserTree:
    """Merges sorted iterators: leaves hold the next line of each run, inner nodes the losers below them."""

    def __init__(self, runs, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = len(self.runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [0] * self.k
        if self.k:
            winners = [0] * self.k + list(range(self.k))
            for node in range(self.k - 1, 0, -1):
                a, b = winners[2 * node], winners[2 * node + 1]
                winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
            self.losers[0] = winners[1] if self.k > 1 else 0

    def _next(self, i: int):
        line = next(self.runs[i], None)
        return None if line is None else (self.key(line), line)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x[0], a) < (y[0], b)

    def __iter__(self):
        while self.k:
            winner = self.losers[0]
            head = self.heads[winner]
            if head is None:
                return
            yield head[1]
            self.heads[winner] = self._next(winner)
            node = (winner + self.k) >> 1
            while node:
                if self._before(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node >>= 1
            self.losers[0] = winner


def write_archives(folder: str):
    """Writes the rows' records under ``tmp``; gives the archives' names, which hold the attempt."""

    def run(batches):
        files, where = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        out, size, number, done = io.BytesIO(), 0, 0, []

        def close():
            name = f"{context.partitionId():06d}-{context.taskAttemptId():08d}-{number:05d}.warc.gz"
            with files.open_output_stream(f"{where}/tmp/{name}", compression=None) as f:
                f.write(out.getvalue())
            return name

        files.create_dir(f"{where}/tmp", recursive=True)
        for batch in batches:
            for r in batch.to_pylist():
                payload = (r["html"] or "").encode("utf-8", "replace")
                out.write(gzip.compress(record(r["kind"], r["page_id"], r["url"] or "", r["time"], payload, r["digest"], r["refers_to"]), 4, mtime=0))
                size += len(payload)
                if size >= ARCHIVE:
                    done.append(close())
                    out, size, number = io.BytesIO(), 0, number + 1
        if size or out.tell():
            done.append(close())
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["archive"])

    return run


def commit_archives(folder: str):
    """Moves the named archives to the folder; may be done again."""

    def run(batches):
        files, where = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                if files.get_file_info(f"{where}/{name}").type == pafs.FileType.NotFound:
                    files.move(f"{where}/tmp/{name}", f"{where}/{name}")
            yield batch

    return run


def read_archives(batches):
    names = [c.split()[0] for c in READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            archive, rows = path.rsplit("/", 1)[-1], []
            for offset, size, data in members(content.as_py()):
                h, block = parse(data)
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                if h["WARC-Type"] == "response":
                    if hashlib.sha1(payload).hexdigest() != digest:
                        raise ArchiveError(f"{archive}, offset {offset}: the payload is not that of its digest")
                    n = len(payload)
                else:
                    n = int(http.decode().rsplit("Content-Length: ", 1)[1].split("\r\n")[0])
                url = h["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                page, refers = h.get("X-Page-ID") or None, h.get("X-Refers-To-Page") or None
                rows.append((page and int(page), url, n, digest, h["WARC-Type"], refers and int(refers), h["WARC-Date"], surt(url), archive, offset, size))
            rows.sort(key=lambda r: (r[7], r[6], r[0] is None, r[0] or 0))  # the archive's capture run
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 10_000]), kinds)], names=names)


def with_records(pages: DataFrame, key: str = "page_id", timestamp=None) -> DataFrame:
    """The pages with digest, record kind and what they refer to."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(
        F.col(key).cast("long").alias("page_id"),
        F.col("url").cast("string"),
        html.alias("html"),
        F.sha1(F.encode(html, "UTF-8")).alias("digest"),
        F.octet_length(html).alias("n"),
        (timestamp if timestamp is not None else F.date_format(F.timestamp_seconds(F.lit(int(START.timestamp())) + F.coalesce(F.col(key), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("time"),
    )
    # A row is known by what it holds, not by its place, so it does not matter in which order a task reads.
    base = base.withColumn("row", F.xxhash64("page_id", "url", "time", "digest", "n"))
    large = base.where((F.col("n") >= REVISIT) & F.col("page_id").isNotNull())
    slim = checkpoint(large.groupBy("row", "page_id", "digest", "n").agg(F.count("*").alias("k")))
    # The largest id of each payload, and the least row of that id, by partial sums.
    first = slim.groupBy("digest", "n").agg(F.max(F.struct("page_id", "row")).alias("top"), F.sum("k").alias("k")).where("k > 1").drop("k")
    linked = checkpoint(slim.join(first, ["digest", "n"]).select("row", "digest", "k", F.col("top.page_id").alias("refers_to"), (F.col("row") == F.col("top.row")).alias("heads")))
    out = base.join(linked.where("NOT heads").select("row", "digest", "refers_to"), ["row", "digest"], "left")
    twins = linked.where("heads AND k > 1").select("row", "digest", F.col("refers_to").alias("own"))
    if twins.take(1):
        # Equal rows that head a payload: the first of them is the response.
        same = base.join(twins, ["row", "digest"]).groupBy(*base.columns, "own").agg(F.count("*").alias("k"))
        same = same.select(*base.columns, "own", F.posexplode(F.sequence(F.lit(1), F.col("k").cast("int")))).select(*base.columns, F.when(F.col("pos") > 0, F.col("own")).alias("refers_to"))
        out = out.join(twins, ["row", "digest"], "left_anti").select(*base.columns, "refers_to").unionByName(same)
    return out.withColumn("kind", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def write_warc(pages: DataFrame, folder: str, timestamp=None) -> int:
    """Writes the pages as archives to a folder that all executors share; gives how many."""
    rows = with_records(pages, timestamp=timestamp).select("page_id", "url", "html", "digest", "time", "kind", "refers_to")
    # What a lost or repeated task has written stays under tmp: only names that came back are moved.
    names = checkpoint(rows.transform(mapped, write_archives(folder), "archive string"))
    return names.transform(mapped, commit_archives(folder), "archive string").count()


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the archives of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    return files.transform(mapped, read_archives, READ)


def merged(pdf_batches):
    """Merges the pieces of runs of a range: rows come by range, run and order within the run."""

    def lines(rows):
        out = [[] for _ in INDEX_COLUMNS]
        for r in rows:
            for c, v in zip(out, r):
                c.append(v)
        return out

    def emit(number, runs):
        tree = LoserTree([runs[k] for k in sorted(runs)], key=lambda r: (r[1], r[2], r[3] is None, r[3] or 0))
        block, place = [], 0
        for r in tree:
            block.append((*r, place))
            place += 1
            if len(block) == 10_000:
                yield batch_of(block)
                block = []
        if block:
            yield batch_of(block)

    def batch_of(block):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block), kinds)], names=[*INDEX_COLUMNS, "place"])

    current, runs = None, {}
    for batch in pdf_batches:
        for row in zip(*(batch.column(c).to_pylist() for c in INDEX_COLUMNS)):
            if row[0] != current:
                if runs:
                    yield from emit(current, runs)
                current, runs = row[0], {}
            runs.setdefault(row[4], []).append(row)
    if runs:
        yield from emit(current, runs)


INDEX_COLUMNS = ["range", "urlkey", "timestamp", "id", "archive", "offset", "size"]


def merge_index(index: DataFrame) -> DataFrame:
    """The lines in global order: place (from 0), and capture (from 1) within the history of their URL key."""
    n = index.count()
    ranges = max(1, min(RANGES, -(-n // RANGE)))
    # A range partitioning cuts all runs at the same splitters; its partitions are the ranges.
    cut = index.repartitionByRange(ranges, "urlkey", "timestamp", "id").withColumn("range", F.spark_partition_id().cast("long"))
    pieces = cut.sortWithinPartitions("archive", "urlkey", "timestamp", F.asc_nulls_last("id"))
    lines = checkpoint(pieces.select(*INDEX_COLUMNS).transform(mapped, merged, "range long, urlkey string, timestamp string, id long, archive string, offset long, size long, place long"))
    # One row for each range, so at most RANGES rows in this window.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("range").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("range", "start")
    placed = lines.join(starts, "range").withColumn("place", F.col("place") + F.col("start"))
    first = placed.groupBy("urlkey").agg(F.min("place").alias("first"))
    return placed.join(first, "urlkey").select("urlkey", "timestamp", "id", "archive", "offset", "size", "place", (F.col("place") - F.col("first") + 1).alias("capture"))


def capture_histories(pages: DataFrame) -> DataFrame:
    """Writes, reads back and indexes the pages: a row for each record."""
    spark = pages.sparkSession
    folder = shared_dir(spark)
    # Without pages there is no archive, and no folder to read.
    records = checkpoint(read_warc(spark, folder)) if write_warc(pages, folder) else spark.createDataFrame([], READ)
    index = merge_index(records.select("urlkey", "timestamp", F.col("page_id").alias("id"), "archive", "offset", "size"))
    return records.join(index.select("archive", "offset", "place", "capture"), ["archive", "offset"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp", "place", "capture")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_histories(table(spark, sf_dir, "pages"))
