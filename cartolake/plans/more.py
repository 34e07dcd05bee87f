"""Further sources, predicates, joins, text and planning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolake.functions import text as X
from cartolake.functions.geo import haversine, haversine_sql
from cartolake.operators import predicates as P
from cartolake.operators.relational import first_per, same_as, within
from cartolake.plans.filters import HERE, PLANNABLE
from cartolake.plans.ranking import FIT, D, around, fit
from cartolake.plans.registry import query
from cartolake.plans.scalars import FOLD, NAMES_SQL, names
from cartolake.sources.tables import Tables

# Projections and predicates


@query("SELECT place_id, name AS primary_name, tags[1] AS top, brand AS brand_name FROM places", "places")
def prj_nested(t: Tables) -> DataFrame:
    nested = t.places.select("place_id", F.struct(F.col("name").alias("primary")).alias("names"), F.struct(F.col("tags").alias("hierarchy")).alias("taxonomy"), F.struct(F.struct(F.col("brand").alias("primary")).alias("names")).alias("brand"))
    return nested.select("place_id", F.col("names.primary").alias("primary_name"), F.get("taxonomy.hierarchy", F.lit(0)).alias("top"), F.col("brand.names.primary").alias("brand_name"))


@query("SELECT p.place_id, CASE WHEN p.indoor THEN p.lat ELSE (c.south + c.north) / 2 END AS lat, CASE WHEN p.indoor THEN p.lon ELSE (c.west + c.east) / 2 END AS lon FROM places p LEFT JOIN cities c USING (city_id)", "places cities")
def prj_element_point(t: Tables) -> DataFrame:
    c = t.cities.select("city_id", ((F.col("south") + F.col("north")) / 2).alias("y"), ((F.col("west") + F.col("east")) / 2).alias("x"))
    return t.places.join(c, "city_id", "left").select("place_id", F.when(F.col("indoor"), F.col("lat")).otherwise(F.col("y")).alias("lat"), F.when(F.col("indoor"), F.col("lon")).otherwise(F.col("x")).alias("lon"))


@query("SELECT place_id, lon AS x, lat AS y FROM places", "places")
def prj_xy(t: Tables) -> DataFrame:
    return t.places.select("place_id", F.col("lon").alias("x"), F.col("lat").alias("y"))


@query("SELECT place_id FROM places WHERE lat >= 40.93e0 AND lat <= 40.99e0 AND lon >= 29.02e0 AND lon <= 29.11e0", "places")
def flt_bbox_exact(t: Tables) -> DataFrame:
    return t.places.where("lat >= 40.93e0 AND lat <= 40.99e0 AND lon >= 29.02e0 AND lon <= 29.11e0").select("place_id")


@query("SELECT district_id, north > south AND east > west AND north - south <= 0.6e0 AND east - west <= 0.6e0 AS valid FROM districts", "districts")
def flt_bbox_limits(t: Tables) -> DataFrame:
    return t.districts.select("district_id", F.expr("north > south AND east > west AND north - south <= 0.6e0 AND east - west <= 0.6e0").alias("valid"))


@query("SELECT place_id FROM places WHERE contains(',' || array_to_string(tags, ',') || ',', ',small,')", "places")
def flt_tag_exact_csv(t: Tables) -> DataFrame:
    return t.places.where(F.array_contains("tags", "small")).select("place_id")


@query(f"SELECT x FROM {NAMES_SQL} WHERE contains({FOLD}, 'isik') OR contains({FOLD}, 'kulesi')", "places")
def flt_name_folded(t: Tables) -> DataFrame:
    folded = X.fold(F.col("x"))
    return names(t).where(F.contains(folded, F.lit("isik")) | F.contains(folded, F.lit("kulesi")))


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '/[a-z]{2}/[0-9]+')")
def flt_regexp_matches(t: Tables) -> DataFrame:
    return t.pages.where(F.rlike("url", F.lit("/[a-z]{2}/[0-9]+"))).select("page_id")


@query("SELECT place_id FROM places WHERE (CAST(NULL AS BIGINT) IS NULL OR city_id = CAST(NULL AS BIGINT)) AND (3 IS NULL OR city_id = 3)", "places")
def flt_optional_param(t: Tables) -> DataFrame:
    """Parameters that are not given leave no trace in the plan."""
    wanted = {"city_id": 3, "category": None}
    return t.places.where(P.all_of(*[F.col(c) == v if v is not None else None for c, v in wanted.items()])).select("place_id")


@query("SELECT event_id FROM events WHERE event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-15' < ts + INTERVAL 7 DAY")
def flt_access_at(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'purchase' AND ts <= TIMESTAMP_NTZ '2024-01-15' AND TIMESTAMP_NTZ '2024-01-15' < ts + INTERVAL 7 DAYS").select("event_id")


@query(f"SELECT place_id, {D} <= 250 + least(place_id % 200, 100) AND place_id % 200 <= 150 AS near FROM places", "places")
def flt_photo_near(t: Tables) -> DataFrame:
    accuracy = F.col("place_id") % 200
    near = (F.col("metres") <= 250 + F.least(accuracy, F.lit(100))) & (accuracy <= 150)
    return around(t.places, 1e6).select("place_id", near.alias("near"))


# Joins


@query(f"SELECT place_id FROM places p WHERE EXISTS (SELECT 1 FROM districts d WHERE {haversine_sql('p.lat', 'p.lon', 'd.south', 'd.west')} <= 900)", "places districts")
def jn_exists_spatial(t: Tables) -> DataFrame:
    shore = t.districts.select("district_id", F.col("south").alias("lat"), F.col("west").alias("lon"))
    # Points meet points; a place is near if its point is.
    near = within(t.places.select("lat", "lon").distinct(), shore.select("lat", "lon").distinct(), 900, "lat", "lat").select("a.lat", "a.lon").distinct()
    return same_as(t.places.select("place_id", "lat", "lon"), near, ["lat", "lon"]).select("place_id")


@query("SELECT DISTINCT s.route_id FROM route_stops s JOIN places p USING (place_id) JOIN cities c ON c.city_id = 12 AND p.lat >= c.south AND p.lat < c.north AND p.lon >= c.west AND p.lon < c.east WHERE s.position = 1", "route_stops places cities")
def jn_contains_filter(t: Tables) -> DataFrame:
    c = F.broadcast(t.cities.where("city_id = 12").select("south", "north", "west", "east"))
    inside = t.places.join(c, F.expr("lat >= south AND lat < north AND lon >= west AND lon < east")).select("place_id")
    return t.route_stops.where("position = 1").join(inside, "place_id", "left_semi").select("route_id").distinct()


@query(f"SELECT s.route_id FROM route_stops s JOIN places p USING (place_id) WHERE s.position = 1 AND {haversine_sql('p.lat', 'p.lon', '41.0e0', '29.1e0')} <= 1500", "route_stops places")
def jn_radius_near(t: Tables) -> DataFrame:
    return t.route_stops.where("position = 1").join(around(t.places, 1500).select("place_id"), "place_id").select("route_id")


NEAR80 = haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")


@query(f"SELECT a.place_id, min(b.place_id) AS same_as FROM places a JOIN places b ON a.source = 'OSM' AND b.source = 'VERIFIED' AND {NEAR80} <= 1500 AND (contains(a.name, b.name) OR contains(b.name, a.name)) GROUP BY a.place_id", "places")
def jn_dedupe_verified(t: Tables) -> DataFrame:
    keys = ["name", "lat", "lon"]
    osm, verified = (t.places.where(F.col("source") == s).select("place_id", *keys) for s in ("OSM", "VERIFIED"))
    # Rows of one name and point are one, the verified ones by their smallest id.
    pairs = within(osm.select(*keys).distinct(), verified.groupBy(*keys).agg(F.min("place_id").alias("place_id")), 1500, "name", "place_id")
    pairs = pairs.where(F.contains("a.name", F.col("b.name")) | F.contains("b.name", F.col("a.name")))
    least = pairs.groupBy("a.name", "a.lat", "a.lon").agg(F.min("b.place_id").alias("same_as"))
    return same_as(osm, least, keys).groupBy("place_id").agg(F.min("same_as").alias("same_as"))


@query("SELECT r.report_id, coalesce(max(u.cost), (SELECT max(cost) FROM usage)) AS hottest FROM reports r LEFT JOIN usage u ON u.created_at BETWEEN date_trunc('hour', r.created_at) AND date_trunc('hour', r.created_at) + INTERVAL 10 MINUTE WHERE r.reason = 'signup' GROUP BY r.report_id", "reports usage")
def jn_weather_window(t: Tables) -> DataFrame:
    """Readings in the window that starts with the hour; all readings where the window is empty."""
    hour = lambda c: F.date_trunc("hour", c)
    windows = t.usage.where(F.col("created_at").cast("timestamp") <= hour("created_at") + F.expr("INTERVAL 10 MINUTES")).groupBy(hour("created_at").alias("hour")).agg(F.max("cost").alias("in_window"))
    every = t.usage.agg(F.max("cost").alias("overall"))
    r = t.reports.where("reason = 'signup'").withColumn("hour", hour("created_at"))
    return r.join(windows, "hour", "left").crossJoin(F.broadcast(every)).select("report_id", F.coalesce("in_window", "overall").alias("hottest"))


# Sorting


@query("SELECT user_id FROM users ORDER BY (user_id = 17) DESC, name LIMIT 10", "users")
def sort_conditional(t: Tables) -> DataFrame:
    return t.users.orderBy((F.col("user_id") == 17).desc(), "name").limit(10).select("user_id")


@query(f"SELECT place_id FROM (SELECT place_id, {FIT} AS fit FROM places WHERE {D} <= 9000 AND {PLANNABLE} ORDER BY fit DESC, place_id LIMIT 12) x ORDER BY (place_id * 7919 + 3 * 104729) % 1000003 % 97, place_id LIMIT 3", "places")
def topk_then_shuffle(t: Tables) -> DataFrame:
    """The best 12 in a seeded shuffle, three of them shown; the shuffle is arithmetic on the id, so that every engine deals alike."""
    best = fit(t.places.where(P.plannable())).orderBy(F.desc("fit"), "place_id").limit(12)
    return best.orderBy(F.expr("(place_id * 7919 + 3 * 104729) % 1000003 % 97"), "place_id").limit(3).select("place_id")


# Text


@query(f"SELECT a, b, least(length(a), length(b)) >= 8 AND (contains(a, b) OR contains(b, a)) AS inside FROM (SELECT DISTINCT a.name AS a, b.name AS b FROM places a JOIN places b ON a.place_id + 1 = b.place_id) x", "places")
def str_contains_full(t: Tables) -> DataFrame:
    b = t.places.select((F.col("place_id") - 1).alias("place_id"), F.col("name").alias("b"))
    pairs = t.places.join(b, "place_id").select(F.col("name").alias("a"), "b").distinct()
    return pairs.select("a", "b", ((F.least(F.length("a"), F.length("b")) >= 8) & (F.contains("a", F.col("b")) | F.contains("b", F.col("a")))).alias("inside"))


@query("SELECT a, b, (contains(a, b) OR contains(b, a)) AND least(length(a), length(b)) >= 5 AND least(length(a), length(b)) >= 0.55e0 * greatest(length(a), length(b)) AS inside FROM (SELECT DISTINCT a.name AS a, b.name AS b FROM places a JOIN places b ON a.place_id + 2 = b.place_id) x", "places")
def str_contained_ratio(t: Tables) -> DataFrame:
    b = t.places.select((F.col("place_id") - 2).alias("place_id"), F.col("name").alias("b"))
    pairs = t.places.join(b, "place_id").select(F.col("name").alias("a"), "b").distinct()
    short, long = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    return pairs.select("a", "b", ((F.contains("a", F.col("b")) | F.contains("b", F.col("a"))) & (short >= 5) & (short >= long * 0.55)).alias("inside"))


#: User agents that the events' clients are taken from.
AGENTS = ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) Safari/604.1", "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0", "Mozilla/5.0 (X11; Linux) Firefox/121.0", "curl/8.0")
AGENT = "CASE event_id % 4 " + " ".join(f"WHEN {n} THEN '{a}'" for n, a in enumerate(AGENTS)) + " END"


@query(
    f"SELECT event_id, (CASE WHEN contains(x, 'Firefox/') THEN 'Firefox' WHEN contains(x, 'Chrome/') THEN 'Chrome' WHEN contains(x, 'Safari/') THEN 'Safari' ELSE 'other' END) || ' on ' || (CASE WHEN contains(x, 'iPhone') THEN 'iOS' WHEN contains(x, 'Windows') THEN 'Windows' WHEN contains(x, 'Linux') THEN 'Linux' ELSE 'other' END) AS device FROM (SELECT event_id, {AGENT} AS x FROM events) v"
)
def str_user_agent(t: Tables) -> DataFrame:
    """Browser and system of every event's client."""

    def first(rules):
        out = F.when(F.contains("x", F.lit(rules[0][0])), rules[0][1])
        for needle, name in rules[1:]:
            out = out.when(F.contains("x", F.lit(needle)), name)
        return out.otherwise("other")

    browser = first([("Firefox/", "Firefox"), ("Chrome/", "Chrome"), ("Safari/", "Safari")])
    system = first([("iPhone", "iOS"), ("Windows", "Windows"), ("Linux", "Linux")])
    return t.events.select("event_id", F.expr(AGENT).alias("x")).select("event_id", F.concat(browser, F.lit(" on "), system).alias("device"))


@query(f"SELECT x, name, regexp_matches(name, '^[a-z0-9]{{3,20}}$') AND name NOT IN ('admin', 'kizkulesi') AS valid FROM (SELECT x, regexp_replace({FOLD}, '[^a-z0-9]', '', 'g') AS name FROM {NAMES_SQL}) y", "places")
def str_username_normalize(t: Tables) -> DataFrame:
    name = F.regexp_replace(X.fold(F.col("x")), "[^a-z0-9]", "")
    return names(t).select("x", name.alias("name"), (F.rlike(name, F.lit("^[a-z0-9]{3,20}$")) & ~name.isin("admin", "kizkulesi")).alias("valid"))


@query("SELECT event_id, CASE WHEN m - 780 BETWEEN -180 AND 180 THEN greatest(m, 780) WHEN m < 780 THEN 780 ELSE 780 + 1440 END AS target FROM (SELECT event_id, hour(created_at) * 60 + minute(created_at) AS m FROM usage) x", "usage")
def dt_upcoming_target(t: Tables) -> DataFrame:
    m = (F.hour("created_at") * 60 + F.minute("created_at")).cast("long")
    return t.usage.select("event_id", F.when((m - 780).between(-180, 180), F.greatest(m, F.lit(780))).when(m < 780, 780).otherwise(2220).alias("target"))


@query("SELECT event_id, len(list_filter(json_keys(props), lambda k: regexp_matches(k, '^[a-z][a-z_]*$') AND k NOT IN ('commons')))::INTEGER AS n FROM events")
def map_sitelink_count(t: Tables) -> DataFrame:
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    return t.events.select("event_id", F.size(F.filter(keys, lambda k: F.rlike(k, F.lit("^[a-z][a-z_]*$")) & ~k.isin("commons"))).alias("n"))


# Classification and planning


@query("SELECT place_id, CASE list_last(list_filter(tags, lambda x: x IN ('widget', 'gear'))) WHEN 'widget' THEN 'mosque' WHEN 'gear' THEN 'church' END AS kind FROM places WHERE category = 'WORSHIP'", "places")
def er_worship_kind(t: Tables) -> DataFrame:
    """The last word that names a kind decides."""
    last = F.try_element_at(F.filter("tags", lambda x: x.isin("widget", "gear")), F.lit(-1))
    return t.places.where("category = 'WORSHIP'").select("place_id", F.when(last == "widget", "mosque").when(last == "gear", "church").alias("kind"))


USED = "place_id NOT IN (SELECT place_id FROM route_stops WHERE route_id = 10)"


@query(f"SELECT place_id FROM places WHERE {PLANNABLE} AND {D} <= 6000 AND {USED} AND place_id IN (SELECT place_id FROM opening_hours WHERE day = 6)", "places route_stops opening_hours")
def pl_candidate_filter(t: Tables) -> DataFrame:
    used = t.route_stops.where("route_id = 10")
    return around(t.places.where(P.plannable()), 6000).join(used, "place_id", "left_anti").join(t.opening_hours.where("day = 6"), "place_id", "left_semi").select("place_id")


BEST = "arg_max(place_id, (round(coalesce(rating, 3.8e0) * 20 - metres / 100, 4), -place_id))"


@query(f"SELECT category AS slot, {BEST} FILTER (cost <= 700) AS affordable, {BEST} AS best FROM (SELECT *, {D} AS metres FROM places WHERE {PLANNABLE}) x WHERE metres <= 8000 GROUP BY category", "places")
def pl_search(t: Tables) -> DataFrame:
    key = F.struct(F.round(F.coalesce("rating", F.lit(3.8)) * 20 - F.col("metres") / 100, 4), -F.col("place_id"), "place_id")
    near = around(t.places.where(P.plannable()), 8000)
    return near.groupBy(F.col("category").alias("slot")).agg(F.max(F.when(F.col("cost") <= 700, key))["place_id"].alias("affordable"), F.max(key)["place_id"].alias("best"))


@query("SELECT route_id, position, NOT (p.hidden OR h.place_id IS NULL) AS pinned FROM route_stops s JOIN places p USING (place_id) LEFT JOIN (SELECT DISTINCT place_id FROM opening_hours) h USING (place_id)", "route_stops places opening_hours")
def pl_pinned(t: Tables) -> DataFrame:
    known = t.opening_hours.select("place_id").distinct().withColumn("known", F.lit(True))
    p = t.places.select("place_id", "hidden").join(known, "place_id", "left")
    return t.route_stops.join(p, "place_id").select("route_id", "position", (~F.col("hidden") & F.col("known").isNotNull()).alias("pinned"))


@query("SELECT city_id, name AS title, votes FROM (SELECT city_id, name, count(*) AS votes, row_number() OVER (PARTITION BY city_id ORDER BY count(*) DESC, name) AS n FROM places GROUP BY city_id, name) x WHERE n = 1", "places")
def pl_area_title(t: Tables) -> DataFrame:
    votes = t.places.groupBy("city_id", F.col("name").alias("title")).agg(F.count("*").alias("votes"))
    return first_per(votes, ["city_id"], [F.desc("votes"), F.col("title")])


@query("SELECT route_id, position, -35 * (count(*) FILTER (p.category = 'WORSHIP') OVER (PARTITION BY route_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS penalty FROM route_stops JOIN places p USING (place_id)", "route_stops places")
def pl_variety(t: Tables) -> DataFrame:
    w = Window.partitionBy("route_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    stops = t.route_stops.join(t.places.select("place_id", "category"), "place_id")
    return stops.select("route_id", "position", (F.count_if(F.col("category") == "WORSHIP").over(w) * -35).alias("penalty"))


@query(f"SELECT place_id FROM (SELECT *, row_number() OVER (PARTITION BY name, floor(lat / 0.02e0), floor(lon / 0.02e0) ORDER BY popularity DESC, place_id) AS n FROM places WHERE {PLANNABLE} AND category IN ('MUSEUM', 'ATTRACTION')) x WHERE n = 1", "places")
def pl_dedupe_sights(t: Tables) -> DataFrame:
    """The most popular of each name in a grid cell."""
    s = t.places.where(P.plannable() & F.col("category").isin("MUSEUM", "ATTRACTION")).withColumns({"y": F.floor(F.col("lat") / 0.02), "x": F.floor(F.col("lon") / 0.02)})
    return first_per(s, ["name", "y", "x"], [F.desc("popularity"), F.col("place_id")]).select("place_id")


LEGS = haversine_sql("lat", "lon", "lag(lat) OVER w", "lag(lon) OVER w")
