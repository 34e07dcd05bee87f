"""Session used by tests, benches and local runs; on a cluster the caller brings its own."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, app: str = "cartolake") -> SparkSession:
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary folder only where all are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/stored-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def discard_stored(spark: SparkSession) -> None:
    """Removes all that this application has stored by shared_path(); for callers whose results are written."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        discard(spark, [f"{named.rstrip('/')}/stored-{spark.sparkContext.applicationId}"])


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Removes stored tables that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
