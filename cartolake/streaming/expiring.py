"""Keyed state that expires: caches with a time to live, limits that count from the first failure, credentials that were replaced.

One processor for each, on Spark's state API. Time is event time: what a value's age is compared with are the rows' own time stamps,
and a timer at a value's end drops it once the watermark has passed, so keys that are never seen again leave no state. Rows
of one key in a micro-batch are taken in order of time (and id); a source's bound on files or rows by trigger is the bound of
what a key can bring at once. Batches come in order of time up to the watermark's delay; older rows are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cartolake.session import shared_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Expiring(StatefulProcessor):
    """State of a key is one row of numbers with its end (microseconds); subclasses say what a row does to it."""

    state = "at long, n long, ends long"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["at", "event_id"])
        now = before = tuple(self.held.get()) if self.held.exists() else None
        out = []
        for row in batch.itertuples(index=False):
            if now is not None and row.at >= now[2]:
                now = None
            now, said = self.step(row, now)
            out += [(row.event_id, key[0], *s) for s in said]
        if now != before:
            for end in list(self.handle.listTimers()):
                self.handle.deleteTimer(int(end[0] if isinstance(end, tuple) else end))
            if now is None:
                self.held.clear()
            else:
                self.held.update(now)
                self.handle.registerTimer(-(-now[2] // 1000))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class Cache(Expiring):
    """Reads fill a key for `ttl` from the miss on (a hit does not lengthen it); an evicting event empties it.

    Says of a read whether it was a hit, of an eviction whether something was evicted and how many hits that had served.
    """

    columns = ["event_id", "user_id", "evicts", "live", "hits"]
    output = "event_id long, user_id long, evicts boolean, live boolean, hits long"

    def step(self, row, now):
        if row.ends:
            return None, [(True, now is not None, now[1] if now else 0)]
        if now is None:
            return (row.at, 0, row.at + self.ttl), [(False, False, 0)]
        return (now[0], now[1] + 1, now[2]), [(False, True, now[1] + 1)]


class Attempts(Expiring):
    """Counts failures from the first one for `ttl`, then forgets them; a success forgets them at once. Says when the limit is reached."""

    columns = ["event_id", "user_id", "since", "until"]
    output = "event_id long, user_id long, since long, until long"

    def __init__(self, ttl: int, limit: int):
        super().__init__(ttl)
        self.limit = limit

    def step(self, row, now):
        if row.ends:
            return None, []
        now = (row.at, 1, row.at + self.ttl) if now is None else (now[0], now[1] + 1, now[2])
        return now, [(now[0], now[2])] if now[1] == self.limit else []


class Replaced(Expiring):
    """A credential's first replacement, remembered for `ttl`; says of uses later than `grace` after it."""

    columns = ["event_id", "user_id", "replaced"]
    output = "event_id long, user_id long, replaced long"

    def __init__(self, ttl: int, grace: int):
        super().__init__(ttl)
        self.grace = grace

    def step(self, row, now):
        if row.ends:
            return (row.at, 0, row.at + self.ttl) if now is None else now, []
        return now, [(now[0],)] if now is not None and row.at > now[0] + self.grace else []


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The store that values and timers need, while a stream starts; the caller's setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def watched(events: DataFrame, processor: Expiring, ends: str, late: str = "1 minute") -> DataFrame:
    """The processor's rows over a stream of events; `ends` is SQL for the rows that end, reset or replace."""
    rows = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(ends).alias("ends")).withWatermark("ts", late)
    rows = rows.withColumn("at", F.unix_micros("ts"))
    return rows.groupBy("user_id").transformWithStateInPandas(processor, processor.output, "append", "eventTime")


def run(spark: SparkSession, source: DataFrame, made: Callable[[DataFrame], DataFrame], progress: list | None = None) -> DataFrame:
    """Runs a stream until its source is read and returns what it has written in the shared folder."""
    path = shared_path(spark, "stream")
    with state_store(spark):
        rows = made(source)
        query = rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


def over_events(spark: SparkSession, sf_dir: str, processor: Expiring, kinds: str, ends: str) -> DataFrame:
    """The processor over the events of the kinds (SQL), read as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parq*t").where(kinds)
    return run(spark, source, lambda s: watched(s, processor, ends))
