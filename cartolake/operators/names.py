"""Places of like names near each other, found by what their names have in common before any distance is computed.

Two names are alike by one of three rules: the core of one (the name without generic words) stands inside the other's; they share
a telling word, or have long ones that are one edit apart; or one whole name stands inside the other. Each rule has signatures
such that names alike by it share one: short words, and the halves of long ones by their length (one edit leaves a half as it
is); and for one name inside another, the rarest four letters in a row of the inner one, which the outer one has among all of
its own. Signatures are joined within cells, so neither rows of a cell nor frequent letters are paired off; candidates
are then checked by the rules and by distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.functions import text as X
from cartolake.functions.geo import haversine
from cartolake.operators.relational import Cells

#: Letters of a word that tells, of one that may have an edit, of a core and of a whole name that may stand inside another.
TELLING, EDITED, CORE, WHOLE = 4, 5, 4, 8
GRAM = 4


def prepared(places: DataFrame, id_col: str, generic: tuple[str, ...], group_col: str | None = None) -> DataFrame:
    """id, lat, lon, kind (null fits all), tokens, core, whole of places with id_col, name, lat, lon."""
    tokens = X.tokens(F.coalesce(F.col("name"), F.lit("")), generic)
    kind = F.col(group_col) if group_col else F.lit(None).cast("string")
    return places.select(F.col(id_col).alias("id"), "lat", "lon", kind.alias("kind"), F.array_distinct(tokens).alias("tokens"), F.array_join(tokens, "").alias("core"), X.fold_key(F.coalesce(F.col("name"), F.lit(""))).alias("whole"))


def _grams(c: Column) -> Column:
    return F.when(F.length(c) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - GRAM + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _posted(tokens: Column) -> Column:
    """The two halves of each long word under its length, and each short telling word as a whole."""
    half = lambda w: F.floor(F.length(w) / 2).cast("int")
    long = F.filter(tokens, lambda w: F.length(w) >= EDITED)
    first = F.transform(long, lambda w: F.concat(F.length(w), F.lit("<"), F.left(w, half(w))))
    last = F.transform(long, lambda w: F.concat(F.length(w), F.lit(">"), F.substring(w, half(w) + 1, F.length(w))))
    return F.concat(_short(tokens), first, last)


def _probed(tokens: Column) -> Column:
    """What a word would share with one that an edit leads to, of its length or one more or less: one edit leaves a half as it is."""
    long = F.filter(tokens, lambda w: F.length(w) >= EDITED)

    def of(w: Column) -> Column:
        lengths = F.filter(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.length(w) + d), lambda n: n >= EDITED)
        half = lambda n: F.floor(n / 2).cast("int")
        return F.concat(F.transform(lengths, lambda n: F.concat(n, F.lit("<"), F.left(w, half(n)))), F.transform(lengths, lambda n: F.concat(n, F.lit(">"), F.right(w, n - half(n)))))

    return F.concat(_short(tokens), F.flatten(F.transform(long, of)))


def _short(tokens: Column) -> Column:
    return F.transform(F.filter(tokens, lambda w: (F.length(w) >= TELLING) & (F.length(w) < EDITED)), lambda w: F.concat(F.lit("="), w))


def _rarest(rows: DataFrame, name: str, least: int, counts: DataFrame) -> DataFrame:
    """id, key of the rarest gram of each name that is long enough to stand inside another."""
    each = rows.where(F.length(name) >= least).select("id", F.explode(_grams(F.col(name))).alias("gram")).join(counts.where(F.col("of") == name), "gram", "left")
    return each.groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), F.col("gram")))["gram"].alias("gram"))


def signatures(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, key) of both sides; names that are alike share a key."""
    counted = None
    for name in ("core", "whole"):
        grams = a.select(_grams(F.col(name)).alias("g")).unionAll(b.select(_grams(F.col(name)).alias("g")))
        of = grams.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).withColumn("of", F.lit(name))
        counted = of if counted is None else counted.unionByName(of)

    def side(rows: DataFrame, mine: str, theirs: str) -> DataFrame:
        marked = lambda name: F.transform(_grams(F.col(name)), lambda g: F.concat(F.lit(f"{theirs}{name}:"), g))
        words = _posted(F.col("tokens")) if mine == "a" else _probed(F.col("tokens"))
        # Cores too short to stand inside another have to be equal.
        equal = F.when(F.length("core") < CORE, F.array(F.concat(F.lit("#"), F.col("core")))).otherwise(F.array().cast("array<string>"))
        keys = F.concat(words, equal, marked("core"), marked("whole"))
        out = rows.select("id", F.explode(F.array_distinct(keys)).alias("key"))
        for name, least in (("core", CORE), ("whole", WHOLE)):
            out = out.unionByName(_rarest(rows, name, least, counted).select("id", F.concat(F.lit(f"{mine}{name}:"), F.col("gram")).alias("key")))
        return out

    # A name of one side posts its rarest gram under that side's mark, where the other side posts all of its grams.
    return side(a, "a", "b"), side(b, "b", "a")


def alike(x: str, y: str) -> Column:
    """The three rules and the kinds, for columns x.* and y.*."""
    inside = lambda c, least: X.same_name(F.col(f"{x}.{c}"), F.col(f"{y}.{c}"), least)
    whole = (F.least(F.length(f"{x}.whole"), F.length(f"{y}.whole")) >= WHOLE) & (F.contains(f"{x}.whole", F.col(f"{y}.whole")) | F.contains(f"{y}.whole", F.col(f"{x}.whole")))
    kinds = F.coalesce(F.col(f"{x}.kind") == F.col(f"{y}.kind"), F.lit(True))
    named = (F.col(f"{x}.core") != "") & (F.col(f"{y}.core") != "")
    return kinds & named & (inside("core", CORE) | X.shares_token(F.col(f"{x}.tokens"), F.col(f"{y}.tokens")) | whole)


def candidates(a: DataFrame, b: DataFrame, metres: float) -> DataFrame:
    """a, b (rows of prepared()), metres: pairs within the radius with a signature in common, each once.

    Signatures carry a place's point, so that pairs too far apart go before repeated ones are dropped and rows are fetched.
    """
    cells = Cells(metres)
    left_keys, right_keys = signatures(a, b)
    left = left_keys.join(a.select(F.col("id"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), cells.of(F.col("lat"), F.col("lon")).alias("c")), "id")
    right = right_keys.join(b.select(F.col("id"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), cells.around(F.col("lat"), F.col("lon")).alias("cs")), "id").select("id", "key", "lat_b", "lon_b", F.explode("cs").alias("c"))
    met = left.select(F.col("id").alias("ida"), "key", "lat_a", "lon_a", "c.y", "c.x").join(right.select(F.col("id").alias("idb"), "key", "lat_b", "lon_b", "c.y", "c.x"), ["key", "y", "x"])
    near = met.withColumn("metres", haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))).where(F.col("metres") <= metres)
    once = near.groupBy("ida", "idb").agg(F.first("metres").alias("metres"))
    return once.join(a.select(F.col("id").alias("ida"), F.struct("*").alias("a")), "ida").join(b.select(F.col("id").alias("idb"), F.struct("*").alias("b")), "idb").select("a", "b", "metres")


def near_and_alike(a: DataFrame, b: DataFrame, metres: float) -> DataFrame:
    """a, b, metres of all pairs that are alike and at most `metres` apart."""
    return candidates(a, b, metres).where(alike("a", "b"))
