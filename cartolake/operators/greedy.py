"""Order-dependent greedy selections as joins, and shortest orders of a few points."""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.session import discard, shared_path


def first_come(ids: DataFrame, rivals: DataFrame) -> DataFrame:
    """The ids (column id) that a pass in order of preference keeps when it drops whatever has a kept rival before it.

    rivals: pairs (before, after), `before` being preferred; the order must have no cycles. No group is ever read in one task,
    however many rows share a name or a place. A round decides every id with a kept rival or without an open one. An id
    with a single open rival is that rival's opposite, so it is replaced by the rival wherever it stands, with the sign turned
    (an id that stands with both signs drops whatever has it so); replacements of replacements double what a round
    contracts, so a chain of equal names takes rounds by the logarithm of its length.
    """
    spark = ids.sparkSession
    paths = []

    def stored(df: DataFrame) -> DataFrame:
        paths.append(shared_path(spark, "rivals"))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    all_ids = ids.select("id").distinct()
    # Only rivals among the ids count.
    pairs = stored(rivals.select("before", "after").distinct().join(all_ids.withColumnRenamed("id", "before"), "before", "left_semi").join(all_ids.withColumnRenamed("id", "after"), "after", "left_semi"))
    later = pairs.select(F.col("after").alias("before"), F.lit(True).alias("later")).distinct()
    # beats: whether `before`, or with `not` its absence, is known to drop `after`; null while open.
    edges = stored(pairs.join(later, "before", "left").select("before", F.lit(False).alias("not"), "after", F.when(F.col("later").isNull(), True).alias("beats")))
    decided = []
    while not edges.isEmpty():
        open_ = F.col("beats").isNull()
        found = edges.groupBy("after").agg(
            F.coalesce(F.bool_or("beats"), F.lit(False)).alias("beaten"), F.min(F.when(open_, F.col("before"))).alias("one"), F.max(F.when(open_, F.col("before"))).alias("other"), F.min(F.when(open_, F.col("not"))).alias("neg"), F.max(F.when(open_, F.col("not"))).alias("neg_too")
        )
        alone = F.col("one") == F.col("other")
        beaten = F.col("beaten") | F.coalesce(alone & (F.col("neg") != F.col("neg_too")), F.lit(False))
        settled = beaten | F.col("one").isNull()
        # `one` and `turned`: the id that decides this one, and whether this one is kept as that is or in its place.
        state = found.select("after", F.when(settled, ~beaten).alias("kept"), F.when(~settled & alone, F.col("one")).alias("one"), F.when(~settled & alone, ~F.col("neg")).alias("turned"))
        # What hangs on an id that this round decides is decided with it, since that id is not met again; what hangs on that waits.
        root = state.where("kept IS NOT NULL").select(F.col("after").alias("one"), F.col("kept").alias("root"))
        state = stored(state.join(root, "one", "left").select("after", F.coalesce("kept", F.col("root") != F.col("turned")).alias("kept"), "one", "turned"))
        gone = state.where("kept IS NOT NULL").select(F.col("after").alias("one"), F.lit(True).alias("gone"))
        state = stored(state.join(gone, "one", "left").select("after", "kept", F.when(F.col("kept").isNull() & F.col("gone").isNull(), F.col("one")).alias("one"), "turned"))
        decided.append(state.where("kept IS NOT NULL").select(F.col("after").alias("id"), "kept"))
        rest = edges.join(state.where("kept IS NULL").select("after"), "after", "left_semi")
        met = rest.join(state.withColumnRenamed("after", "before"), "before", "left")
        sign = F.when(F.col("turned"), ~F.col("not")).otherwise(F.col("not"))
        beats = F.coalesce("beats", F.col("kept") != F.col("not"))
        edges = stored(met.select(F.coalesce("one", "before").alias("before"), F.when(F.col("one").isNotNull(), sign).otherwise(F.col("not")).alias("not"), "after", beats.alias("beats")).distinct())
    if not decided:
        discard(spark, paths)
        return all_ids
    dropped = functools.reduce(DataFrame.union, decided).where("NOT kept").select("id")
    kept = spark.read.schema(dropped.schema).parquet(_written(dropped, shared_path(spark, "dropped")))
    discard(spark, paths)
    return all_ids.join(kept, "id", "left_anti")


def _written(df: DataFrame, path: str) -> str:
    df.write.parquet(path)
    return path


def metres(a: tuple, b: tuple) -> float:
    y, x = math.radians(b[0] - a[0]), math.radians(b[1] - a[1])
    h = math.sin(y / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(x / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(h)))


def shortest_order(points: list[tuple]) -> list[int]:
    """Visiting order of at most 5 points that walks least; ties to the first in order of places."""
    return min((list(p) for p in itertools.permutations(range(len(points)))), key=lambda p: (round(sum(metres(points[a], points[b]) for a, b in itertools.pairwise(p)), 3), p))
