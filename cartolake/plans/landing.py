"""Sources as they land: nested JSON answers and partitioned tables (inventory 2.1). The answers are written from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.plans.registry import query
from cartolake.session import shared_path
from cartolake.sources.tables import Tables

WEATHER = "struct<hourly:struct<time:array<string>,temperature:array<double>,rain:array<int>>>"
ENTITIES = "struct<entities:map<string,struct<id:string,sitelinks:map<string,struct<title:string>>,claims:map<string,array<struct<mainsnak:struct<datavalue:struct<value:struct<id:string>>>>>>>>>"
VIEWS = "struct<query:struct<normalized:array<struct<`from`:string,to:string>>,redirects:array<struct<`from`:string,to:string>>,pages:array<struct<title:string,pageviews:map<string,long>>>>>"


@query("SELECT event_id, i AS hour, k + i * 0.5e0 AS temperature, CAST(nullif((k + i) % 4, 3) AS INTEGER) AS rain FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, unnest(range(0, 3)) AS i FROM events) x")
def src_weather(t: Tables) -> DataFrame:
    """Parallel arrays of a forecast zipped to one row an hour; a value that is missing in an hour stays null."""
    k = F.get_json_object("props", "$.k").cast("long")
    hours = F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))
    array = lambda f: F.concat(F.lit("["), F.array_join(F.transform(hours, lambda i: F.coalesce(f(i).cast("string"), F.lit("null"))), ","), F.lit("]"))
    answer = F.concat(F.lit('{"hourly":{"time":'), array(lambda i: F.concat(F.lit('"2024-01-01T0'), i.cast("string"), F.lit(':00"'))), F.lit(',"temperature":'), array(lambda i: k + i * 0.5), F.lit(',"rain":'), array(lambda i: F.nullif((k + i) % 4, F.lit(3))), F.lit("}}"))
    read = t.events.select("event_id", F.from_json(answer, WEATHER).alias("a"))
    rows = read.select("event_id", F.explode(F.arrays_zip("a.hourly.time", "a.hourly.temperature", "a.hourly.rain")).alias("h"))
    return rows.select("event_id", F.hour(F.to_timestamp("h.time", "yyyy-MM-dd'T'HH:mm")).cast("long").alias("hour"), "h.temperature", "h.rain")


@query(
    "SELECT 'Q' || event_id AS item, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS wikipedias, CASE WHEN event_id % 3 = 0 THEN 'Yer ' || event_id END AS tr, 'Place ' || event_id AS en, CASE WHEN event_id % 2 = 0 THEN 'Q5,Q33506' ELSE 'Q33506' END AS instance_of FROM events WHERE event_type <> 'error'"
)
def src_wikidata(t: Tables) -> DataFrame:
    """Items of an answer: number of Wikipedias among the site links, titles, and what the item is an instance of; missing items go."""
    e, even, third = F.col("event_id").cast("string"), F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0
    claim = lambda q: f'{{"mainsnak":{{"datavalue":{{"value":{{"id":"{q}"}}}}}}}}'
    claims = F.when(even, f'[{claim("Q5")},{claim("Q33506")},{{"mainsnak":{{}}}}]').otherwise(f'[{claim("Q33506")}]')
    links = F.concat(F.lit('{"commonswiki":{"title":"File"},"enwiki":{"title":"Place '), e, F.lit('"}'), F.when(third, F.concat(F.lit(',"trwiki":{"title":"Yer '), e, F.lit('"}'))).otherwise(""), F.lit(',"enwikivoyage":{"title":"x"}}'))
    entity = F.when(F.col("event_type") == "error", F.lit("null")).otherwise(F.concat(F.lit('{"id":"Q'), e, F.lit('","sitelinks":'), links, F.lit(',"claims":{"P31":'), claims, F.lit("}}")))
    answer = F.concat(F.lit('{"entities":{"Q'), e, F.lit('":'), entity, F.lit("}}"))
    rows = t.events.select(F.explode(F.from_json(answer, ENTITIES)["entities"]).alias("item", "v")).where("v IS NOT NULL")
    wikis = F.map_filter("v.sitelinks", lambda k, _: F.rlike(k, F.lit("^[a-z_]+wiki$")) & (k != "commonswiki"))
    kinds = F.array_compact(F.transform(F.element_at("v.claims", "P31"), lambda c: c["mainsnak"]["datavalue"]["value"]["id"]))
    title = lambda k: F.try_element_at("v.sitelinks", F.lit(k))["title"]
    return rows.select("item", F.size(wikis).alias("wikipedias"), title("trwiki").alias("tr"), title("enwiki").alias("en"), F.array_join(kinds, ",").alias("instance_of"))


@query(
    "SELECT 'Place_' || (event_id % 50) AS requested, CAST(sum(greatest(0, CAST(json_extract_string(props, '$.k') AS BIGINT) - 5) + CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS views FROM events GROUP BY 1"
)
def src_pageviews(t: Tables) -> DataFrame:
    """Daily views summed by the title that was asked for, followed back through normalised spellings and redirects."""
    # Equal answers are read once and count as often as they came.
    events = t.events.groupBy((F.col("event_id") % 50).cast("string").alias("n"), F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("times"))
    n, k = F.col("n"), F.col("k")
    answer = F.concat(
        F.lit('{"query":{"normalized":[{"from":"Place_'), n, F.lit('","to":"Place '), n, F.lit('"}],"redirects":[{"from":"Place '), n, F.lit('","to":"Town '), n,
        F.lit('"}],"pages":[{"title":"Town '), n, F.lit('","pageviews":{"d1":'), (k - 5).cast("string"), F.lit(',"d2":null,"d3":'), k.cast("string"), F.lit('}},{"title":"Else"}]}}'),
    )
    read = events.select("times", F.concat(F.lit("Place_"), n).alias("requested"), F.from_json(answer, VIEWS)["query"].alias("q"))
    renamed = F.concat(F.coalesce("q.normalized", F.array()), F.coalesce("q.redirects", F.array()))
    step = lambda title: F.coalesce(F.get(F.filter(renamed, lambda r: r["from"] == title), F.lit(0))["to"], title)
    title = step(step(step(F.col("requested"))))
    page = F.get(F.filter("q.pages", lambda p: p["title"] == title), F.lit(0))
    total = F.aggregate(F.map_values(page["pageviews"]), F.lit(0).cast("long"), lambda a, v: a + F.greatest(F.coalesce(v, F.lit(0)), F.lit(0)))
    return read.select("requested", (total * F.col("times")).alias("views")).where("views IS NOT NULL").groupBy("requested").agg(F.sum("views").alias("views"))


@query("SELECT event_type, CAST(user_id AS BIGINT) AS user_id, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def src_parquet_hive(t: Tables) -> DataFrame:
    """A table partitioned by type, of which only the asked for partitions are listed and read."""
    path = shared_path(t.spark, "events")
    # A type is spread over several files, so that none of its few values is one task's work.
    t.events.repartition("event_type", F.pmod(F.xxhash64("event_id"), F.lit(8))).write.partitionBy("event_type").parquet(path)
    landed = t.spark.read.parquet(path)
    return landed.where("event_type IN ('click', 'view')").groupBy("event_type", F.col("user_id").cast("long").alias("user_id")).agg(F.count("*").alias("n"))
