"""Map extracts, map answers and listings: written as they are given out, and read back (inventory 2.1 and 2.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.plans.registry import query
from cartolake.session import shared_path
from cartolake.sources.extract import ExtractSource
from cartolake.sources.listing import ListingSource, write_pages
from cartolake.sources.tables import Tables

KEYS = ("amenity", "shop", "tourism", "leisure", "historic", "access", "name")
PAIRS = ", ".join(f"'{k}', {k}" for k in KEYS)


def raw_elements(t: Tables) -> DataFrame:
    """The elements with their places, as extracts hold them."""
    at = t.places.select("place_id", "lat", "lon")
    tags = F.map_filter(F.expr(f"map({PAIRS})"), lambda _, v: v.isNotNull())
    rows = t.elements.join(at, F.col("element_id") == F.col("place_id"))
    return rows.select(F.col("element_id").alias("id"), (F.col("element_id") % 7).cast("int").alias("version"), "lat", "lon", (F.lit(1_700_000_000) + F.col("element_id") * 61).cast("long").alias("changed"), tags.alias("tags"))


def written(t: Tables, rows: DataFrame, block: int) -> str:
    """A new extract in the shared folder; rows are in order of id, since neighbours' differences are what is stored."""
    t.spark.dataSource.register(ExtractSource)
    path = shared_path(t.spark, "extract")
    rows.repartitionByRange("id").sortWithinPartitions("id").write.format("extract").option("block", block).mode("append").save(path)
    return path


COUNT = " + ".join(f"(CASE WHEN {k} IS NOT NULL THEN 1 ELSE 0 END)" for k in KEYS)


@query(f"SELECT element_id AS id, round(lat, 7) AS lat, round(lon, 7) AS lon, amenity, name, CAST({COUNT} AS INT) AS n_tags FROM (SELECT elements.*, lat, lon FROM elements JOIN places ON place_id = element_id) x", "elements places")
def src_pbf(t: Tables) -> DataFrame:
    """The elements from an extract of compressed blocks: ids, places and tags, decoded by column in as many tasks as it has runs of blocks."""
    path = written(t, raw_elements(t), 1000)
    read = t.spark.read.format("extract").option("columns", "id,lat,lon,tags").option("split", 1 << 16).load(path)
    return read.select("id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.col("tags")["amenity"].alias("amenity"), F.col("tags")["name"].alias("name"), F.size("tags").alias("n_tags"))


@query("SELECT element_id AS id, CAST(element_id % 7 AS INT) AS version, CAST(1700000000 + element_id * 61 AS BIGINT) AS changed FROM elements UNION ALL SELECT -element_id, CAST(element_id % 7 AS INT), CAST(1700000000 + element_id * 61 AS BIGINT) FROM elements WHERE amenity = 'cafe'", "elements")
def snk_batch_chunks(t: Tables) -> DataFrame:
    """Elements written in bounded chunks by two commits, the second of which adds rows, and read back."""
    rows = raw_elements(t)
    path = written(t, rows, 500)
    more = rows.where("tags['amenity'] = 'cafe'").withColumn("id", -F.col("id"))
    more.write.format("extract").option("block", 500).mode("append").save(path)
    return t.spark.read.format("extract").option("columns", "id,version,changed").load(path)


#: The map service's answer, by the columns that are read.
ANSWER = "struct<elements:array<struct<type:string,id:bigint,version:int,lat:double,lon:double,changed:bigint,tags:map<string,string>>>>"
PER_ANSWER = 250


def answers(t: Tables) -> str:
    """JSON answers of bounded size in the shared folder, with a broken one among them."""
    path = shared_path(t.spark, "answers")
    item = F.struct(F.lit("node").alias("type"), "id", "version", "lat", "lon", "changed", "tags")
    rows = raw_elements(t).groupBy(F.floor(F.col("id") / PER_ANSWER).alias("n")).agg(F.to_json(F.struct(F.collect_list(item).alias("elements"))).alias("value"))
    broken = t.cities.limit(1).select(F.lit(-1).cast("long").alias("n"), F.lit('{"remark": "timed out", "elements": [').alias("value"))
    rows.unionByName(broken).select("value").write.text(path)
    return path


def from_answers(t: Tables, path: str) -> DataFrame:
    """Elements of all answers that can be read; one that is cut off brings none."""
    read = t.spark.read.text(path).select(F.from_json("value", ANSWER, {"mode": "PERMISSIVE"}).alias("a"))
    return read.select(F.inline(F.coalesce("a.elements", F.array().cast("array<struct<type:string,id:bigint,version:int,lat:double,lon:double,changed:bigint,tags:map<string,string>>>")))).select("id", "version", "lat", "lon", "changed", "tags")


def from_extract(t: Tables, path: str) -> DataFrame:
    t.spark.dataSource.register(ExtractSource)
    return t.spark.read.format("extract").load(path)


#: Where elements come from: both give the same columns.
SOURCES = {"answers": from_answers, "extract": from_extract}


@query(f"SELECT element_id AS id, round(lat, 6) AS lat, amenity, name, CAST({COUNT} AS INT) AS n_tags FROM (SELECT elements.*, lat FROM elements JOIN places ON place_id = element_id) x", "elements places")
def src_overpass(t: Tables) -> DataFrame:
    """Elements from the JSON answers of a map service, read with an explicit schema."""
    read = from_answers(t, answers(t))
    return read.select("id", F.round("lat", 6).alias("lat"), F.col("tags")["amenity"].alias("amenity"), F.col("tags")["name"].alias("name"), F.size("tags").alias("n_tags"))


@query("SELECT kind, count(*) AS n, CAST(sum(element_id) AS BIGINT) AS ids, count(name) AS named FROM elements, (VALUES ('answers'), ('extract')) k(kind) GROUP BY kind", "elements")
def src_source_switch(t: Tables) -> DataFrame:
    """The same elements from either source, chosen by name."""
    paths = {"answers": answers(t), "extract": written(t, raw_elements(t), 1000)}
    out = None
    for kind, load in SOURCES.items():
        found = load(t, paths[kind]).agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.count(F.col("tags")["name"]).alias("named")).select(F.lit(kind).alias("kind"), "n", "ids", "named")
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT place_id, name FROM places", "places")
def src_paged_rest(t: Tables) -> DataFrame:
    """All pages of a listing, in runs that tasks page through."""
    t.spark.dataSource.register(ListingSource)
    path = shared_path(t.spark, "listing")
    write_pages(t.places.select("place_id", "name"), path, 100)
    return t.spark.read.format("listing").option("size", 100).load(path)


GUIDE = "row_number() OVER (PARTITION BY city_id ORDER BY rating DESC NULLS LAST, popularity DESC, place_id)"


@query(f"SELECT city_id, CAST(count(*) AS INT) AS entries, min(place_id) FILTER (n = 1) AS best, string_agg(name, ', ' ORDER BY n) AS names FROM (SELECT city_id, place_id, name, {GUIDE} AS n FROM places WHERE NOT hidden) x WHERE n <= 10 GROUP BY city_id", "places")
def snk_html_pages(t: Tables) -> DataFrame:
    """Guide pages written as one JSON document for each city, in folders by city, and read back: the ten best places in order."""
    from cartolake.operators.relational import first_per

    path = shared_path(t.spark, "guides")
    order = [F.col("rating").desc_nulls_last(), F.desc("popularity"), F.col("place_id")]
    best = first_per(t.places.where("NOT hidden"), ["city_id"], order, 10).select("city_id", F.struct((-F.coalesce("rating", F.lit(-1.0))).alias("k"), (-F.col("popularity")).alias("l"), "place_id", "name").alias("e"))
    pages = best.groupBy("city_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.struct(e["place_id"].alias("place_id"), e["name"].alias("name"))).alias("entries"))
    pages.write.partitionBy("city_id").json(path)
    read = t.spark.read.schema("entries array<struct<place_id:bigint,name:string>>, city_id bigint").json(path)
    return read.select("city_id", F.size("entries").alias("entries"), F.get("entries", F.lit(0))["place_id"].alias("best"), F.array_join(F.transform("entries", lambda e: e["name"]), ", ").alias("names"))
