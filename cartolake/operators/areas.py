"""Areas named in messages: a trie of the names' words, broadcast where it is small, probed once for each token."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.functions import text as X
from cartolake.functions.text import ENDINGS

#: Most names that are sent to every task; more are joined instead.
MOST_NAMES = 500_000
#: Letters of the longest ending.
LONGEST = max(map(len, ENDINGS))


def _tokens(text: str):
    return F.filter(F.transform(F.split(X.fold(F.col(text)), "[^a-z0-9']+"), lambda w: F.regexp_replace(w, "^'+|'+$", "")), lambda w: w != "")


class Trie:
    """Names by their words: a node holds what may follow, and under None the name that ends there.

    A name's last word may carry an ending in the text, the others may not. So a walk goes on by whole tokens, and ends at
    any beginning of a token whose rest is an ending, with or without an apostrophe between.
    """

    def __init__(self, names: list[str]):
        self.root: dict = {}
        for name in names:
            node = self.root
            for word in name.split(" "):
                node = node.setdefault(word, {})
            node[None] = name

    def found(self, tokens: list[str]) -> set[str]:
        out = set()
        for i in range(len(tokens)):
            node = self.root
            for token in tokens[i:]:
                for cut in range(min(LONGEST, len(token) - 1) + 1):
                    stem, ending = token[: len(token) - cut], token[len(token) - cut :]
                    if ending in _ENDINGS:
                        for word in {stem, stem.removesuffix("'")}:
                            if None in node.get(word, ()):
                                out.add(node[word][None])
                node = node.get(token)
                if node is None:
                    break
        return out


_ENDINGS = frozenset(ENDINGS)


def _said(messages: DataFrame, names: DataFrame, key: str, text: str, current: str) -> DataFrame:
    """k, here, gram: the names (column gram) that each message has, in any number of words."""
    spark = messages.sparkSession
    cut = messages.select(F.col(key).alias("k"), F.col(current).cast("long").alias("here"), _tokens(text).alias("tokens")).where(F.size("tokens") > 0)
    grams = names.select("gram").where("gram <> ''").distinct()
    first = grams.limit(MOST_NAMES + 1).collect()
    if len(first) > MOST_NAMES:
        return _joined(cut, grams)
    # Built once by the driver and sent to each executor once.
    trie = spark.sparkContext.broadcast(Trie(sorted(r["gram"] for r in first)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = trie.value
        for batch in batches:
            hits = [known.found(tokens) for tokens in batch.column(2).to_pylist()]
            at = pa.array([n for n, h in enumerate(hits) for _ in h], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([g for h in hits for g in h], pa.string())], ["k", "here", "gram"])

    return cut.mapInArrow(probe, f"k {cut.schema['k'].dataType.simpleString()}, here long, gram string")


def _joined(cut: DataFrame, grams: DataFrame) -> DataFrame:
    """The same for names of any number, by joins: first tokens with first words, and only where those meet, runs with names."""
    words = grams.withColumn("words", F.split("gram", " "))
    stems = lambda token: F.array_distinct(F.array_compact(F.array(*[F.when(F.endswith(token, F.lit(e)) & (F.length(token) > len(e)), F.left(token, F.length(token) - len(e))) for e in ENDINGS])))
    bare = lambda token: F.array_distinct(F.concat(stems(token), F.transform(stems(token), lambda s: F.regexp_replace(s, "'$", ""))))
    each = cut.select("k", "here", "tokens", F.posexplode("tokens").alias("i", "token"))
    one = each.select("k", "here", F.explode(bare(F.col("token"))).alias("gram")).join(words.where(F.size("words") == 1).select("gram"), "gram")
    more = words.where(F.size("words") > 1).select("gram", "words", F.get("words", F.lit(0)).alias("token"))
    met = each.join(more, "token").where(F.slice("tokens", F.col("i") + 1, F.size("words") - 1) == F.slice("words", F.lit(1), F.size("words") - 1))
    last = F.get("tokens", F.col("i") + F.size("words") - 1)
    many = met.where(F.array_contains(bare(last), F.element_at("words", -1)))
    return one.select("k", "here", "gram").unionByName(many.select("k", "here", "gram")).distinct()


def named_areas(messages: DataFrame, areas: DataFrame, key: str, text: str, current: str) -> DataFrame:
    """key, kind, area_id of the area that each message means; messages that name none are left out.

    areas: kind (CITY or another), area_id, city_id, name. A name that a city has means the city. Other areas count in the
    cities that the message names, if it names any. A name of several cities counts where the message names one of them, else
    in the message's current city, else not at all. Longer names win, then those in the current city, then the smallest id;
    a message without another area means the city of the longest name.
    """
    names = areas.select("kind", "area_id", "city_id", F.array_join(X.words(F.col("name")), " ").alias("gram"))
    said = _said(messages, names, key, text, current)
    # Of the areas of one name in one city only the first counts; what a name has in all is counted before messages meet it.
    first = names.groupBy("gram", (F.col("kind") == "CITY").alias("is_city"), "city_id").agg(F.min(F.struct("area_id", "kind")).alias("a")).select("gram", "is_city", "city_id", "a.area_id", "a.kind")
    several = first.groupBy("gram").agg((F.countDistinct(F.coalesce(F.col("city_id").cast("string"), F.lit("")))).alias("in_cities"))
    known = first.join(several, "gram").withColumn("longest", -F.length(F.replace("gram", F.lit(" "), F.lit("")))).hint("merge")
    met = said.join(known, "gram")
    # A message is a few words, so what it has met is a short array; one shuffle by message serves all rules.
    by = met.groupBy("k").agg(F.first("here").alias("here"), F.collect_set(F.struct("gram", "longest", "kind", "area_id", "city_id", "in_cities")).alias("hits"))
    cities = F.filter("hits", lambda h: h["kind"] == "CITY")
    by = by.select("k", "here", "hits", F.transform(cities, lambda h: h["city_id"]).alias("cities"), F.transform(cities, lambda h: h["gram"]).alias("taken"), F.array_min(F.transform(cities, lambda h: F.struct(h["longest"], h["area_id"])))["area_id"].alias("city"))
    counts = lambda h: F.when(F.size("cities") > 0, F.array_contains("cities", h["city_id"])).otherwise((h["in_cities"] <= 1) | F.coalesce(h["city_id"] == F.col("here"), F.lit(False)))
    usable = F.filter("hits", lambda h: (h["kind"] != "CITY") & ~F.array_contains("taken", h["gram"]) & counts(h))
    best = F.array_min(F.transform(usable, lambda h: F.struct(h["longest"].alias("longest"), F.coalesce(h["city_id"] != F.col("here"), F.lit(True)).alias("away"), h["area_id"].alias("area_id"), h["kind"].alias("kind"))))
    found = by.select("k", best.alias("best"), "city").where("best IS NOT NULL OR city IS NOT NULL")
    return found.select(F.col("k").alias(key), F.coalesce("best.kind", F.lit("CITY")).alias("kind"), F.coalesce("best.area_id", "city").alias("area_id"))
