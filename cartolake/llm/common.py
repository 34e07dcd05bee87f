"""Helpers shared by the corpus operators: shared storage, text batches."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Upper bound of rows handed to Python at once; with BATCH_BYTES it keeps workers small.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    """Where saved() writes: one folder for each application, so it can be removed as a whole."""
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_saved(spark: SparkSession) -> None:
    """Removes all tables that saved() has written in this application; for callers that have stored their results."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get, in rows and, where Spark knows it, in bytes.

    Spark reads these settings when a job starts, after an operator has returned its DataFrame, so they stay; they are only
    ever lowered, a caller's smaller bound holds.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        present = (spark.conf.get(key, None) or "").lower().removesuffix("b")
        if not present.isdigit() or not 0 < int(present) <= most:
            spark.conf.set(key, str(most))


@contextmanager
def wide_batches(spark: SparkSession, rows: int = 100_000) -> Iterator[None]:
    """Larger batches for the jobs run inside, whose rows are a few numbers; the caller's bound is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column as one array, and len + 1 offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(lengths: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `most` bytes together, a longer row alone."""
    a, total = 0, 0
    for b, size in enumerate(lengths.tolist()):
        if b > a and total + size > most:
            yield a, b
            a, total = b, 0
        total += size
    if a < len(lengths):
        yield a, len(lengths)


def texts(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def released() -> None:
    """Drops what a reused Python worker still holds of the tokenizer's word tables, before work that has no use for them."""
    held = sys.modules.get("cartolake.llm.bpe")
    if held is not None:
        held._LOADED.clear()
