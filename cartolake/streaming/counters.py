"""Windowed counters and sessions; the same functions serve batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolake.session import shared_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def per_window(events: DataFrame, size: str, offset: str | None = None, key: str = "user_id", time: str = "ts") -> DataFrame:
    """starts, key, calls of each fixed window."""
    window = F.window(time, size, size, offset) if offset else F.window(time, size)
    return events.groupBy(window.alias("w"), key).agg(F.count("*").alias("calls")).select(F.col("w.start").alias("starts"), key, "calls")


def sessions(events: DataFrame, gap: str, key: str = "user_id", time: str = "ts") -> DataFrame:
    """key, starts, ends, uses of each session that a pause of `gap` ends; hot keys are merged map-side first."""
    found = events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("uses"))
    return found.select(key, F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "uses")


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Watermarked hourly counts and sums by type; for streams and batches."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("value"))
    return counted.select(F.col("w.start").alias("starts"), "event_type", "calls", "value")


def over_limit(events: DataFrame, limit: int = 30, late: str = "2 minutes") -> DataFrame:
    """Keys with more than `limit` calls in a minute, for streams and batches."""
    calls = events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w"), "user_id").agg(F.count("*").alias("calls"))
    return calls.where(F.col("calls") > limit).select(F.col("w.start").alias("starts"), "user_id", "calls")


def run_stream(spark: SparkSession, sf_dir: str, counted, keys: list[str]) -> DataFrame:
    """Reads the events as a stream until nothing is left and returns the last state of each key.

    Each batch writes the windows that it changed to a folder of its own under the shared folder, so a batch that runs again
    writes the same once more; state older than the watermark is dropped. Nothing passes through the driver.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A stream reads folders or patterns; the pattern matches the one table, be it a file or a folder.
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parq*t")
    changes = counted(source.withColumn("ts", F.col("ts").cast("timestamp")))
    path = shared_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    run = changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    values = [c for c in changes.columns if c not in keys]
    written = spark.read.schema(T.StructType([*changes.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/out")
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, "last.*").withColumn("starts", F.col("starts").cast("timestamp_ntz"))


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stream(spark, sf_dir, hourly, ["starts", "event_type"])


def stream_over_limit(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    return run_stream(spark, sf_dir, lambda events: over_limit(events, limit), ["starts", "user_id"])
