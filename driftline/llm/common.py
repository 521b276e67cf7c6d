"""Helpers that the training-data operators share.

Intermediate tables go to the folder that every executor shares
(``spark.checkpoint.dir``), so that a lost executor never takes the only copy
with it.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import ship

#: Characters that separate words, as a Java and SQL character class.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes of text that one numpy pass handles; temporaries are some 60 times that.
SLICE_BYTES = 1 << 19
#: Rows of an id set that may be broadcast (about 64 MB as a hash relation); a larger one is shuffled.
BROADCAST_IDS = 1_000_000


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is set, one is made on a local master; a cluster has to name its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_driftline_dir", None)
    if own is None:
        own = spark.sparkContext._driftline_dir = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(own)
    return f"file://{own}"


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/driftline-{label}-{uuid.uuid4().hex}"


@contextmanager
def release_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes made within go as soon as the written table is complete."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    with release_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(staged: DataFrame) -> None:
    """Deletes the folder of a staged table that nothing reads any more; of another table, nothing."""
    path = getattr(staged, "_staged_at", None)
    if path:
        context = staged.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


#: Bytes of an Arrow batch that goes to a Python task.
ARROW_BYTES = 8 << 20


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Readies the session for Python tasks: Arrow batches of at most so many rows and ARROW_BYTES, as texts can be long.

    A lazy result reads these settings when it runs, so they stay lowered for
    the session; results do not depend on them.
    """
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        try:
            now = int("".join(c for c in spark.conf.get(key) if c in "-0123456789"))
        except Exception:  # a setting that this Spark does not have
            continue
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker gives freed memory back to the system when the task ends: workers are kept for later stages."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return done


def keep_ids(docs: DataFrame, ids: DataFrame, n_ids: int, how: str = "left_semi") -> DataFrame:
    """docs with (left_semi) or without (left_anti) the doc_ids in ids.

    The id table is broadcast only if it has at most BROADCAST_IDS rows.
    """
    right = ids.select(F.col("doc_id").alias("_id"))
    right = F.broadcast(right) if n_ids <= BROADCAST_IDS else right
    return docs.join(right, docs["doc_id"].eqNullSafe(right["_id"]), how)


def keep_rows(docs: DataFrame, rows: DataFrame, n_rows: int, key: Column, how: str = "left_semi") -> DataFrame:
    """docs with (left_semi) or without (left_anti) the rows that rows (doc_id, _row) names; key gives a row's _row. Broadcast as in keep_ids."""
    right = rows.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_named"))
    right = F.broadcast(right) if n_rows <= BROADCAST_IDS else right
    return docs.join(right, docs["doc_id"].eqNullSafe(right["_id"]) & (key == right["_named"]), how)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the n + 1 offsets."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, off - off[0]


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about limit bytes of text, a row at least."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
