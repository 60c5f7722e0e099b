"""Small helpers shared by the operators."""

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that a Python worker gets, about; a longer row comes alone.
BATCH = 8 << 20
#: Row keys: task in the high bits, row of the task in the low 33.
ROW_BITS = 33


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local one is set only where that is unset (tests)."""
    ready_checkpoints(spark)
    base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{uuid.uuid4().hex}"


def ready_checkpoints(spark: SparkSession) -> None:
    """checkpoint() needs a directory: the one the cluster names; a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="flatspark-"))


def checkpoint(df: DataFrame) -> DataFrame:
    ready_checkpoints(df.sparkSession)
    return df.checkpoint()


def released(run):
    """The same function of batches; its worker, which Spark keeps for later tasks, gives memory back at its end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with batches of about ``BATCH`` bytes (set for the session, as it is read when the plan runs)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return df.mapInArrow(released(run), schema)


def fold(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def least_hashed(rows: DataFrame, column: str, n: int) -> DataFrame:
    """At most ``n`` rows with the least 64-bit hashes in ``column``.

    Rows are counted first; a bound on the hash, which some more than ``n`` of them keep, then goes into
    the scan, so no task and no driver meets more rows than that however large the table is.
    """
    total = rows.count()
    wanted = 1.1 * n + 100
    if total > wanted:
        rows = rows.where(F.col(column) < F.lit(int(wanted / total * 2**64) - 2**63).cast("long"))
    return rows.orderBy(column, *(c for c in rows.columns if c != column)).limit(n)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def row_keys(task: int, first: int, n: int) -> pa.Array:
    return pa.array((np.int64(task) << ROW_BITS) + np.arange(first, first + n, dtype=np.int64))
