"""Sources, projections and predicates (inventory 2.1, 2.3, 2.4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.functions.geo import haversine_sql, near
from cartolake.functions.text import fold
from cartolake.operators import predicates as P
from cartolake.plans.registry import query
from cartolake.sources.tables import Tables

HERE = (41.0, 29.1)


@query("SELECT p_partkey AS place_id, p_name AS name FROM part WHERE p_size > 10")
def src_table_scan(t: Tables) -> DataFrame:
    return t.part.where("p_size > 10").select(F.col("p_partkey").alias("place_id"), F.col("p_name").alias("name"))


@query("SELECT v.id, v.label, p_name AS name FROM (VALUES (1, 'one'), (2, 'two'), (3, 'three')) v(id, label) JOIN part ON p_partkey = v.id")
def src_values(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES (1, 'one'), (2, 'two'), (3, 'three') AS v(id, label)")
    return t.part.join(F.broadcast(v), F.col("p_partkey") == F.col("id")).select("id", "label", F.col("p_name").alias("name"))


@query("SELECT s_suppkey AS id, d.day FROM supplier CROSS JOIN (SELECT unnest(range(1, 8)) AS day) d WHERE d.day >= 1 + s_suppkey % 7")
def src_generate_series(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.explode(F.sequence(F.lit(1).cast("long") + F.col("s_suppkey") % 7, F.lit(7).cast("long"))).alias("day"))


@query("SELECT p_partkey AS place_id, w AS word FROM (SELECT p_partkey, unnest(split(p_name, ' ')) AS w FROM part) x")
def src_unnest_param(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("place_id"), F.explode(F.split("p_name", " ")).alias("word"))


@query(
    "SELECT id, min(rnk) AS source FROM (SELECT p_partkey AS id, 1 AS rnk FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, 2 FROM part WHERE p_size > 10) x GROUP BY id"
)
def src_split_queries(t: Tables) -> DataFrame:
    a = t.part.where("p_size < 20").select(F.col("p_partkey").alias("id"), F.lit(1).alias("source"))
    b = t.part.where("p_size > 10").select(F.col("p_partkey").alias("id"), F.lit(2).alias("source"))
    return a.unionByName(b).groupBy("id").agg(F.min("source").alias("source"))


@query("SELECT place_id, lat, lon, (lat + 41.0e0) / 2 AS mid_lat, (lon + 29.0e0) / 2 AS mid_lon FROM places", "places")
def prj_bbox_center(t: Tables) -> DataFrame:
    return t.places.select("place_id", "lat", "lon", ((F.col("lat") + 41.0) / 2).alias("mid_lat"), ((F.col("lon") + 29.0) / 2).alias("mid_lon"))


@query(
    "SELECT place_id, CASE WHEN category IN ('RESTAURANT','CAFE','BAR') THEN 'food' WHEN category IN ('MUSEUM','ATTRACTION','VIEWPOINT') THEN 'sight' WHEN category = 'PARK' THEN 'green' WHEN category = 'WORSHIP' THEN 'worship' ELSE 'shop' END AS purpose FROM places",
    "places",
)
def prj_case_purpose(t: Tables) -> DataFrame:
    c = F.col("category")
    purpose = F.when(c.isin("RESTAURANT", "CAFE", "BAR"), "food").when(c.isin("MUSEUM", "ATTRACTION", "VIEWPOINT"), "sight").when(c == "PARK", "green").when(c == "WORSHIP", "worship").otherwise("shop")
    return t.places.select("place_id", purpose.alias("purpose"))


@query(
    "SELECT place_id, CASE WHEN source = 'VERIFIED' THEN 0 ELSE 1 END AS verified_rank, CASE WHEN has_image THEN 0 ELSE 1 END AS image_rank FROM places",
    "places",
)
def prj_rank_keys(t: Tables) -> DataFrame:
    return t.places.select("place_id", F.when(F.col("source") == "VERIFIED", 0).otherwise(1).alias("verified_rank"), F.when(F.col("has_image"), 0).otherwise(1).alias("image_rank"))


@query("SELECT place_id, source NOT IN ('OSM', 'OVERTURE') AS verified, rating IS NOT NULL AS rated FROM places", "places")
def prj_bool_as_col(t: Tables) -> DataFrame:
    return t.places.select("place_id", (~F.col("source").isin("OSM", "OVERTURE")).alias("verified"), F.col("rating").isNotNull().alias("rated"))


@query(
    "SELECT p.place_id, coalesce(c.name, d.name) AS area FROM places p LEFT JOIN cities c ON c.city_id = p.city_id AND c.region_id < 2 LEFT JOIN districts d ON d.district_id = p.place_id % 10",
    "places cities districts",
)
def prj_coalesce_dims(t: Tables) -> DataFrame:
    c = t.cities.where("region_id < 2").select("city_id", F.col("name").alias("city"))
    d = t.districts.select("district_id", F.col("name").alias("district"))
    return t.places.join(c, "city_id", "left").join(d, F.col("place_id") % 10 == F.col("district_id"), "left").select("place_id", F.coalesce("city", "district").alias("area"))


@query("SELECT place_id, CASE WHEN place_id % 2 = 0 THEN name ELSE upper(name) END AS label FROM places", "places")
def prj_bilingual(t: Tables) -> DataFrame:
    return t.places.select("place_id", F.when(F.col("place_id") % 2 == 0, F.col("name")).otherwise(F.upper("name")).alias("label"))


@query("SELECT place_id, category FROM places WHERE NOT hidden AND NOT unconfirmed AND category NOT IN ('MARKET', 'WORSHIP')", "places")
def flt_listed(t: Tables) -> DataFrame:
    return t.places.where(P.listed()).select("place_id", "category")


PLANNABLE = "NOT hidden AND NOT unconfirmed AND review IS NULL AND NOT inside_institution"


@query(f"SELECT place_id, category FROM places WHERE {PLANNABLE}", "places")
def flt_plannable(t: Tables) -> DataFrame:
    return t.places.where(P.plannable()).select("place_id", "category")


@query(f"SELECT place_id, category FROM places WHERE {PLANNABLE} AND (category IN ('CAFE', 'RESTAURANT') OR list_contains(tags, 'widget'))", "places")
def flt_fills_stop(t: Tables) -> DataFrame:
    return t.places.where(P.fills_stop(["CAFE", "RESTAURANT"], "widget")).select("place_id", "category")


@query(f"SELECT place_id FROM places WHERE {haversine_sql('lat', 'lon', '41.0e0', '29.1e0')} <= 1500", "places")
def flt_dwithin(t: Tables) -> DataFrame:
    return t.places.where(near(F.col("lat"), F.col("lon"), HERE, 1500)).select("place_id")


@query("SELECT place_id FROM places WHERE lat BETWEEN 40.95e0 AND 41.02e0 AND lon BETWEEN 29.05e0 AND 29.12e0", "places")
def flt_bbox_op(t: Tables) -> DataFrame:
    return t.places.where(F.col("lat").between(40.95, 41.02) & F.col("lon").between(29.05, 29.12)).select("place_id")


@query("SELECT place_id FROM places WHERE list_contains(tags, 'small')", "places")
def flt_array_any(t: Tables) -> DataFrame:
    return t.places.where(F.array_contains("tags", "small")).select("place_id")


@query("SELECT place_id FROM places WHERE list_has_any(tags, split('small,cold', ','))", "places")
def flt_array_overlap(t: Tables) -> DataFrame:
    return t.places.where(F.arrays_overlap("tags", F.split(F.lit("small,cold"), ","))).select("place_id")


@query("SELECT place_id FROM places WHERE list_has_any(tags, ['widget', 'gear'])", "places")
def flt_list_has_any(t: Tables) -> DataFrame:
    return t.places.where(F.arrays_overlap("tags", F.array(F.lit("widget"), F.lit("gear")))).select("place_id")


@query("SELECT place_id FROM places WHERE lower(name) LIKE '%small%' OR lower(name) LIKE '%cold%'", "places")
def flt_like_any_dynamic(t: Tables) -> DataFrame:
    return t.places.where(F.exists(F.split(F.lit("%small%,%cold%"), ","), lambda p: F.like(fold(F.col("name")), p))).select("place_id")


@query("SELECT place_id FROM places WHERE contains(lower(name), 'l w')", "places")
def flt_like_escaped(t: Tables) -> DataFrame:
    return t.places.where(F.contains(F.lower("name"), F.lit("l w"))).select("place_id")


@query("SELECT place_id, name FROM places WHERE NOT hidden AND category = 'CAFE' AND cost <= 600 AND indoor", "places")
def flt_search_spec(t: Tables) -> DataFrame:
    return t.places.where(P.search(category="CAFE", max_cost=600, indoor=True)).select("place_id", "name")


@query("SELECT place_id FROM places WHERE regexp_matches(name, '(?i)\\bcold\\b') AND NOT regexp_matches(name, '(?i)\\bgear\\b')", "places")
def flt_regex(t: Tables) -> DataFrame:
    return t.places.where(F.rlike("name", F.lit(r"(?i)\bcold\b")) & ~F.rlike("name", F.lit(r"(?i)\bgear\b"))).select("place_id")


@query("SELECT place_id, rating IS DISTINCT FROM 3.5e0 AS differs FROM places", "places")
def flt_null_safe(t: Tables) -> DataFrame:
    return t.places.select("place_id", (~F.col("rating").eqNullSafe(3.5)).alias("differs"))


@query("SELECT event_id FROM usage WHERE NOT ok OR created_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY", "usage")
def flt_ttl_due(t: Tables) -> DataFrame:
    due = F.lit("2024-01-20 00:00:00").cast("timestamp") - F.expr("INTERVAL 7 DAYS")
    return t.usage.where(~F.col("ok") | (F.col("created_at") < due)).select("event_id")


@query("SELECT place_id FROM places WHERE lat BETWEEN 35.5e0 AND 42.5e0 AND lon BETWEEN 25.5e0 AND 45.0e0", "places")
def flt_plausible_coords(t: Tables) -> DataFrame:
    return t.places.where(F.col("lat").between(35.5, 42.5) & F.col("lon").between(25.5, 45.0)).select("place_id")


@query(
    "SELECT photo_id, CASE WHEN toxic = 1 THEN 'UNSAFE' WHEN quality < 1 THEN 'UNCLEAR' ELSE NULL END AS reject FROM photos",
    "photos",
)
def flt_photo_decide(t: Tables) -> DataFrame:
    return t.photos.select("photo_id", F.when(F.col("toxic") == 1, "UNSAFE").when(F.col("quality") < 1, "UNCLEAR").alias("reject"))


@query(
    "SELECT place_id, bool_or(opens <= 21 * 60 AND CASE WHEN closes <= opens THEN closes + 1440 ELSE closes END >= 22 * 60) AS open_then FROM (SELECT p.place_id, h.opens, h.closes FROM places p LEFT JOIN opening_hours h ON h.place_id = p.place_id AND h.day = 5) x GROUP BY place_id",
    "places opening_hours",
)
def flt_open_during(t: Tables) -> DataFrame:
    """Friday 21:00 to 22:00; NULL where hours are unknown. After-midnight closing runs over into the next day."""
    from cartolake.functions.scores import closes_at

    covers = (F.col("opens") <= 21 * 60) & (closes_at(F.col("opens"), F.col("closes")) >= 22 * 60)
    hours = t.opening_hours.where("day = 5").groupBy("place_id").agg(F.bool_or(covers).alias("open_then"))
    return t.places.select("place_id").join(hours, "place_id", "left")
