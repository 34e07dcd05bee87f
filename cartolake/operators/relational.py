"""Grouped selection, upserts and similarity joins."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolake.functions.geo import EARTH_M, haversine, lon_reach


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; Spark drops the rest before the shuffle where it can."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_at") <= n).drop("_at")


def beyond(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The rows after the first n of each key."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_at") > n).drop("_at")


def upsert(old: DataFrame, new: DataFrame, key: str, update: dict[str, Column] | None = None, guard: Column | None = None) -> DataFrame:
    """old with the rows of new put in or over it, by a full outer join on the key.

    `update` gives the value of a column in terms of o.* and n.* (by default the new one); where `guard` fails the old row
    stays.
    """
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    known, came = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    put = came & (~known | (guard if guard is not None else F.lit(True)))
    columns = [F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key)]
    for c in old.columns:
        if c == key:
            continue
        if c not in new.columns and c not in (update or {}):
            columns.append(F.col(f"o.{c}").alias(c))
            continue
        value = (update or {}).get(c, F.col(f"n.{c}") if c in new.columns else F.col(f"o.{c}"))
        columns.append(F.when(put, value).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*columns)


class Cells:
    """Grid cells for a radius: two places that are at most `metres` apart are in the same cell or in neighbouring ones.

    Bands of latitude are as high as the radius, and each is cut into cells as wide as the radius is at the poleward edge of
    the next band, a whole number of them around the globe; so no pair is missed at any latitude, around a pole or across
    the antimeridian. Longitudes are from -180 to 180; a null coordinate has no cell.
    """

    def __init__(self, metres: float):
        self.metres, self.height = metres, math.degrees(metres / EARTH_M) * 1.001

    def _column(self, lon: Column, band: Column) -> tuple[Column, Column]:
        edge = F.greatest(F.abs(band - 1), F.abs(band + 2)) * self.height
        count = F.greatest(F.lit(1), F.floor(360 / lon_reach(self.metres, edge)))
        return F.pmod(F.floor((lon + 180) * count / 360), count), count

    def of(self, lat: Column, lon: Column) -> Column:
        """The cell (y, x) of a place."""
        band = F.floor(lat / self.height)
        return F.struct(band.alias("y"), self._column(lon, band)[0].alias("x"))

    def around(self, lat: Column, lon: Column) -> Column:
        """The cell of a place and those around it, each once."""
        band = F.floor(lat / self.height)

        def row(y: Column) -> Column:
            x, count = self._column(lon, y)
            return F.transform(F.array_distinct(F.array(*[F.pmod(x + k, count) for k in (-1, 0, 1)])), lambda c: F.struct(y.alias("y"), c.alias("x")))

        return F.flatten(F.array(*[row(band + k) for k in (-1, 0, 1)]))


def within(a: DataFrame, b: DataFrame, metres: float, a_id: str, b_id: str, keep: list[Column] | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows at most `metres` apart: a goes to its grid cell, b to its own and the eight around it, and cells are joined.

    a and b bring lat and lon; rows with a null coordinate meet nothing. `on`: columns in which both agree. b is never broadcast:
    its size is guessed from its files, before each row becomes nine.
    """
    cells = Cells(metres)
    more = [f"on_{c}" for c in on]
    of = [F.col(c).alias(f"on_{c}") for c in on]
    left = a.select(F.struct("*").alias("a"), *of, cells.of(F.col("lat"), F.col("lon")).alias("c")).select("a", *more, "c.y", "c.x")
    right = b.select(F.struct("*").alias("b"), *of, F.explode(cells.around(F.col("lat"), F.col("lon"))).alias("c")).select("b", *more, "c.y", "c.x")
    distance = haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return left.join(right.hint("merge"), ["y", "x", *more]).drop("y", "x", *more).withColumn("metres", distance).where(F.col("metres") <= metres)


def same_as(df: DataFrame, found: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df with the columns of found, the row that agrees in keys (nulls agree): what was worked out once for equal rows comes back to each."""
    other = found.withColumnsRenamed({k: f"_{k}" for k in keys}).hint("merge")
    agree = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(other, agree, how).drop(*[f"_{k}" for k in keys])


def chunks(df: DataFrame, keys: list[str], id_col: str, most: int = 256) -> DataFrame:
    """keys, chunk, ids: the ids of the rows that agree in keys, in arrays of some `most`, so that no group is one row."""
    count = df.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias("_chunks"))
    dealt = same_as(df, count, keys).withColumn("chunk", F.pmod(F.xxhash64(id_col), F.col("_chunks")))
    return dealt.groupBy(*keys, "chunk").agg(F.collect_list(id_col).alias("ids"))


def expanded(pairs: DataFrame, a: DataFrame, a_keys: list[str], a_id: str, b: DataFrame, b_keys: list[str], b_id: str) -> DataFrame:
    """The rows of pairs (a_keys, b_keys and others) for each id of a and of b that has these keys, without the keys.

    Ids are dealt in arrays, and pairs of arrays are dealt evenly before they become rows: the result may be as large as
    the product of both sides, but what is shuffled is not, and no key is one task's.
    """
    left, right = chunks(a, a_keys, a_id), chunks(b, b_keys, b_id)
    more = [c for c in pairs.columns if c not in (*a_keys, *b_keys)]
    met = same_as(same_as(pairs, left.select(*a_keys, F.col("ids").alias("_a")), a_keys), right.select(*b_keys, F.col("ids").alias("_b")), b_keys)
    n = shuffle_tasks(pairs)
    dealt = met.repartition(n, F.xxhash64("_a"), F.xxhash64("_b")).select(*more, F.explode("_a").alias(a_id), "_b")
    return dealt.select(*more, a_id, F.explode("_b").alias(b_id))


def shuffle_tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) * 4


def nearest_in_time(asked: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """asked (id, key, at) with `nearest`, the id of the known row (id, key, at) of its key that is nearest in time; ties go to the
    earlier one, then to the smaller id. Rows of keys that have no known row are left out.

    Both sides are cut into buckets of `width` by key and time, so a hot key is spread over its buckets. What a bucket cannot
    know, the last known row before it and the first after it, is carried over from one row for each bucket: its own first and
    last known rows. Within a bucket one order gives the neighbours. Work is linear in rows but for the orders.
    """
    bucket = F.floor(F.col("at") / width)
    k = known.select("key", bucket.alias("bucket"), "at", "id").where("key IS NOT NULL AND at IS NOT NULL")
    # Of known rows at one time only the one of the smallest id counts.
    k = k.groupBy("key", "bucket", "at").agg(F.min("id").alias("id"))
    a = asked.select("key", bucket.alias("bucket"), "at", F.col("id").alias("asked")).where("key IS NOT NULL AND at IS NOT NULL")
    ends = k.groupBy("key", "bucket").agg(F.min(F.struct("at", "id")).alias("first"), F.max(F.struct("at", "id")).alias("last"))
    open_ = a.select("key", "bucket").distinct()
    by_key = Window.partitionBy("key").orderBy("bucket")  # a row for each bucket of a key
    carried = open_.join(ends, ["key", "bucket"], "full").select(
        "key", "bucket", F.last("last", True).over(by_key.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(by_key.rowsBetween(1, Window.unboundedFollowing)).alias("after")
    )
    point = F.struct("at", "id")
    both = a.select("key", "bucket", "at", F.lit(1).alias("asks"), "asked", F.lit(None).cast(point_type(k)).alias("p")).unionByName(k.select("key", "bucket", "at", F.lit(0).alias("asks"), F.lit(None).cast(a.schema["asked"].dataType).alias("asked"), point.alias("p")))
    inside = Window.partitionBy("key", "bucket").orderBy("at", "asks")
    # A known row at the same time comes before what asks, so it is the last one before.
    met = both.withColumns({"left": F.last("p", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "right": F.first("p", True).over(inside.rowsBetween(0, Window.unboundedFollowing))}).where("asks = 1")
    found = met.join(carried, ["key", "bucket"]).select("asked", "at", F.coalesce("left", "before").alias("left"), F.coalesce("right", "after").alias("right"))
    nearer = F.col("right").isNotNull() & (F.col("left").isNull() | (F.col("right.at") - F.col("at") < F.col("at") - F.col("left.at")))
    return found.where("left IS NOT NULL OR right IS NOT NULL").select(F.col("asked").alias("id"), F.when(nearer, F.col("right.id")).otherwise(F.col("left.id")).alias("nearest"))


def point_type(k: DataFrame) -> str:
    return f"struct<at:{k.schema['at'].dataType.simpleString()},id:{k.schema['id'].dataType.simpleString()}>"
