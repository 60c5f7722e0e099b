"""Secret scans with corpus-wide ownership frequency.

Base kinds: ``assign`` (a credential word, then : or =, then a value of 6 or more characters),
``access`` (AKIA keys of 20 or more characters) and ``hex`` (24 or more hexadecimal digits), leftmost
non-overlapping each. The kind ``token`` adds other runs of 20 or more characters with letters and
digits. All values are hashed (128 bits) within the scan; the hashes are counted over the corpus by
distinct owners and by distinct repositories. A value that ``EXAMPLE_OWNERS`` or more owners have, or
``EXAMPLE_REPOSITORIES`` or more repositories of however few owners, is copied widely and an example; an owner's own
credential is in few places. So is one an example of which placeholder words make up half or more, or whose entropy is below
``MIN_ENTROPY`` bits or, for short values, below ``SHARE`` of what its length allows; others are
live-looking. Base spans are always reported; a ``token`` span only if it is live-looking.

Only hashes and positions are shuffled, never texts. Counting dedups a value within each document
before the shuffle and sums partially, and a value in a third of all rows meets its count in a join
whose skewed side Spark splits.

Defined results: a null or empty text has no span; a null owner or repository counts as the empty
one; repeated rows each get their result, and count once as a repository; an empty table gives an
empty result; other columns of the input do not matter.
"""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, fresh, mapped, row_keys, table
from .textops import slices, text_buffer

KINDS = ("assign", "access", "hex", "token")
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 20
MIN_ENTROPY = 2.5
SHARE = 0.6
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more is what is kept of [0-9a-f]+
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PLACEHOLDER = re.compile(r"example|changeme|placeholder|sample|dummy|your|xxxx|1234567|abcdef", re.I | re.A)

CANDIDATES = "array<struct<kind: int, start: int, end: int, hash: string, looks: boolean>>"
SCHEMA = f"uid long, doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found {CANDIDATES}"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    filler = sum(len(m[0]) for m in PLACEHOLDER.finditer(value))
    return entropy(value) >= min(MIN_ENTROPY, SHARE * math.log2(len(value))) and 2 * filler < len(value)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def added_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Runs with letters and digits that no base span overlaps."""
    out = []
    for m in TOKEN.finditer(text):
        v = m[0]
        if re.search("[0-9]", v) and re.search("[A-Za-z]", v) and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
            out.append((m.start(), 3, m.end(), v))
    return out


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("looks", pa.bool_())]))


def candidates(text: str) -> tuple[list, list[dict]]:
    """The base spans of a text, and all candidates with the hashes of their values."""
    base = base_spans(text)
    return base, [{"kind": k, "start": s, "end": e, "hash": hashlib.blake2b(v.encode(), digest_size=16).hexdigest(), "looks": looks_live(v)} for s, k, e, v in base + added_spans(text, base)]


def scan(batches):
    task, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        _, offsets = text_buffer(batch.column("text"))
        for lo, hi in slices(offsets):
            counts, shas, found = [], [], []
            for text in batch.column("text").slice(lo, hi - lo).to_pylist():
                base, own = candidates(text or "")
                counts.append([sum(s[1] == k for s in base) for k in range(3)])
                shas.append(hashlib.sha256(written(base).encode()).hexdigest())
                found.append(own)
            counts = np.array(counts, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [row_keys(task, done, hi - lo), *(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "repo", "owner")), *(pa.array(counts[:, i]) for i in range(3)), pa.array(shas, pa.string()), pa.array(found, FOUND)],
                names=["uid", "doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
            )
            done += hi - lo


def scanned(documents: DataFrame, repository: str, owner: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return checkpoint(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text(repository).alias("repo"), text(owner).alias("owner")).transform(mapped, scan, SCHEMA))


def judged(rows: DataFrame) -> DataFrame:
    """Each candidate with the owners and repositories of its value; live says what it looks like."""
    each = rows.where(F.size("found") > 0).select("uid", "repo", "owner", F.explode("found").alias("f")).select("uid", "repo", "owner", "f.*")
    owned = each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    live = F.col("looks") & (F.col("owners") < EXAMPLE_OWNERS) & (F.col("repos") < EXAMPLE_REPOSITORIES)
    return each.join(owned, "hash").select("uid", "kind", "start", "end", "owners", "repos", live.alias("live"))


def scan_secrets(documents: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """A row for each document: base counts and digest, all spans, and how many look live or like examples."""
    rows = scanned(documents, repository, owner)
    shown = judged(rows).where("kind < 3 OR live")
    spans = shown.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("s"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
        F.max("repos").alias("most_repositories"),
    )
    named = F.transform("s", lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"]))
    return rows.join(spans, "uid", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(F.array_join(named, ","), F.lit("")).alias("spans"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_example", "most_repositories"))
    )


def marked(key: str, found: str):
    """The rows with a key and their candidates."""

    def run(batches):
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = text_buffer(batch.column("text"))
            for lo, hi in slices(offsets):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, row_keys(task, done, hi - lo), pa.array([candidates(t or "")[1] for t in part.column("text").to_pylist()], FOUND)], names=[*part.schema.names, key, found])
                done += hi - lo

    return run


def redactor(mark: str, cut_name: str, columns: list[str]):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else None
            for i, (text, cut) in enumerate(zip(texts, batch.column(cut_name).to_pylist())):
                if text and cut:
                    out, at = [], 0
                    for c in cut:
                        if c["start"] >= at:
                            out += [text[at : c["start"]], mark]
                        at = max(at, c["end"])
                    texts[i] = "".join([*out, text[at:]])
                    if sizes:
                        sizes[i] = len(texts[i])
            made = {"text": texts, "n_chars": sizes}
            yield pa.RecordBatch.from_arrays([batch.column(c) if made.get(c) is None else pa.array(made[c], batch.schema.field(c).type) for c in columns], names=columns)

    return run


def redact_live(documents: DataFrame, repository: str = "doc_id", owner: str = "source", mark: str = "<secret>") -> DataFrame:
    """The documents, with live-looking credentials replaced; same columns.

    Texts are scanned once, and rows and candidates written together. Null, empty and repeated rows stay as
    they are; of overlapping spans the earlier one counts; n_chars, where there is one, follows the text.
    """
    key, found, cut = (fresh(documents, n) for n in ("uid", "found", "cut"))
    kinds = [T.StructField(key, T.LongType()), T.StructField(found, T._parse_datatype_string(CANDIDATES))]
    rows = checkpoint(documents.withColumn("text", F.col("text").cast("string")).transform(mapped, marked(key, found), T.StructType([*documents.schema.fields, *kinds])))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    judged_rows = judged(rows.select(F.col(key).alias("uid"), text(repository).alias("repo"), text(owner).alias("owner"), F.col(found).alias("found"))).where("live")
    cuts = judged_rows.groupBy(F.col("uid").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cut))
    clean, rest = rows.where(F.size(found) == 0).select(documents.columns), rows.where(F.size(found) > 0).drop(found)
    return clean.unionByName(rest.join(cuts, key, "left").transform(mapped, redactor(mark, cut, documents.columns), documents.schema))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
