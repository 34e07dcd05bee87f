"""Scalar functions (inventory 2.10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.functions import scores as S
from cartolake.functions import text as X
from cartolake.functions.geo import haversine, haversine_sql, in_ring, walk_minutes
from cartolake.plans.aggregates import LOCAL_SQL, local_day
from cartolake.plans.registry import query
from cartolake.sources.tables import Tables

FOLD = f"lower(translate(x, '{X.MARKED}', '{X.PLAIN}'))"
#: Some Turkish names, a fixed list to try text functions on beside the tables.
NAMES = "('İstiklal Caddesi'), ('IŞIK Kafe'), ('  Çiğ-Köfteci  Ömer!'), ('Dolmabahçe Sarayı'), ('kız kulesi'), ('ab')"


def names(t: Tables) -> DataFrame:
    return t.places.select(F.col("name").alias("x")).union(t.spark.sql(f"SELECT * FROM VALUES {NAMES} AS v(x)")).distinct()


NAMES_SQL = f"(SELECT name AS x FROM places UNION SELECT x FROM (VALUES {NAMES}) v(x)) n"


@query(f"SELECT x, {FOLD} AS folded FROM {NAMES_SQL}", "places")
def str_fold_ascii(t: Tables) -> DataFrame:
    return names(t).select("x", X.fold(F.col("x")).alias("folded"))


@query(f"SELECT x, regexp_replace({FOLD}, '[^a-z0-9]+', '', 'g') AS key FROM {NAMES_SQL}", "places")
def str_fold_key(t: Tables) -> DataFrame:
    return names(t).select("x", X.fold_key(F.col("x")).alias("key"))


@query(f"SELECT x, lower(replace(replace(x, 'İ', 'i'), 'I', 'ı')) AS lowered FROM {NAMES_SQL}", "places")
def str_lower_tr(t: Tables) -> DataFrame:
    return names(t).select("x", X.lower_tr(F.col("x")).alias("lowered"))


@query(f"SELECT x, regexp_replace(regexp_replace({FOLD}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM {NAMES_SQL}", "places")
def str_slug(t: Tables) -> DataFrame:
    return names(t).select("x", X.slug(F.col("x")).alias("slug"))


@query("SELECT place_id, lower(translate(name || ' ' || coalesce(review, ''), 'abc', 'xyz')) AS out FROM places", "places")
def str_translate_sql(t: Tables) -> DataFrame:
    return t.places.select("place_id", F.lower(F.translate(F.concat(F.col("name"), F.lit(" "), F.coalesce("review", F.lit(""))), "abc", "xyz")).alias("out"))


@query(f"SELECT x, array_to_string(list_filter(regexp_split_to_array({FOLD}, '[^a-z0-9]+'), lambda w: w <> ''), '|') AS words FROM {NAMES_SQL}", "places")
def str_words(t: Tables) -> DataFrame:
    return names(t).select("x", F.array_join(X.words(F.col("x")), "|").alias("words"))


@query(f"SELECT x, left(regexp_replace(split_part({FOLD}, ' ', 1), '[^a-z0-9]', '', 'g'), 12) AS base FROM {NAMES_SQL}", "places")
def str_username_base(t: Tables) -> DataFrame:
    first = F.split_part(X.fold(F.col("x")), F.lit(" "), F.lit(1))
    return names(t).select("x", F.left(F.regexp_replace(first, "[^a-z0-9]", ""), F.lit(12)).alias("base"))


#: Words that say what a place is, not which.
GENERIC = ("cafe", "kafe", "widget", "restaurant", "gear")


PAIRS_SQL = "(SELECT DISTINCT name FROM places) a JOIN (SELECT DISTINCT name FROM places) b ON a.name < b.name"


def pairs(t: Tables) -> DataFrame:
    """Pairs of place names that share a word; the words of names are a small vocabulary."""
    d = t.places.select("name").distinct().withColumn("w", F.explode(F.array_distinct(F.split("name", " "))))
    return d.alias("p").join(d.alias("q"), (F.col("p.w") == F.col("q.w")) & (F.col("p.name") < F.col("q.name"))).select(F.col("p.name").alias("a"), F.col("q.name").alias("b")).distinct()


SHARED_SQL = f"(SELECT a.name AS a, b.name AS b FROM {PAIRS_SQL} WHERE list_has_any(split(a.name, ' '), split(b.name, ' '))) p"


@query(f"SELECT a, b, contains(CASE WHEN length(a) <= length(b) THEN b ELSE a END, CASE WHEN length(a) <= length(b) THEN a ELSE b END) AND least(length(a), length(b)) >= 4 AS same FROM {SHARED_SQL}", "places")
def str_same_name(t: Tables) -> DataFrame:
    return pairs(t).select("a", "b", X.same_name(F.col("a"), F.col("b")).alias("same"))


@query(
    f"SELECT a, b, len(list_filter(split(a, ' '), lambda x: len(list_filter(split(b, ' '), lambda y: (x = y AND length(x) >= 4) OR (length(x) >= 5 AND length(y) >= 5 AND levenshtein(x, y) <= 1))) > 0)) > 0 AS shares FROM {SHARED_SQL}",
    "places",
)
def str_shares_token(t: Tables) -> DataFrame:
    return pairs(t).select("a", "b", X.shares_token(F.split("a", " "), F.split("b", " ")).alias("shares"))


@query(f"SELECT a, b, levenshtein(a, b) <= 1 AS near FROM {SHARED_SQL}", "places")
def str_one_edit(t: Tables) -> DataFrame:
    return pairs(t).select("a", "b", (F.levenshtein("a", "b") <= 1).alias("near"))


TRIGRAMS = "list_distinct(CASE WHEN length({0}) < 3 THEN [{0}] ELSE list_transform(range(1, length({0}) - 1), lambda i: substring({0}, i, 3)) END)"


@query(
    f"SELECT a, b, round(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 6) AS likeness FROM (SELECT a, b, {TRIGRAMS.format('a')} AS ta, {TRIGRAMS.format('b')} AS tb FROM {SHARED_SQL}) q",
    "places",
)
def str_trigram_jaccard(t: Tables) -> DataFrame:
    return pairs(t).select("a", "b", F.round(X.jaccard(X.trigrams(F.col("a")), X.trigrams(F.col("b"))), 6).alias("likeness"))


@query("SELECT user_id, CASE WHEN length(regexp_replace(name, '\\D', '', 'g')) >= 8 THEN right(regexp_replace(name, '\\D', '', 'g'), 8) END AS key FROM users", "users")
def str_phone_key(t: Tables) -> DataFrame:
    digits = F.regexp_replace("name", r"\D", "")
    return t.users.select("user_id", F.when(F.length(digits) >= 8, F.right(digits, F.lit(8))).alias("key"))


@query("SELECT place_id, CASE WHEN lower(brand) <> lower(name) THEN brand END AS name_en FROM places", "places")
def str_choose_name(t: Tables) -> DataFrame:
    return t.places.select("place_id", F.when(X.fold(F.col("brand")) != X.fold(F.col("name")), F.col("brand")).alias("name_en"))


@query("SELECT event_id, regexp_extract(props, '\\d+') AS digits FROM events")
def str_wikidata_id(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.regexp_extract("props", r"(\d+)", 1).alias("digits"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)/([^?]*)', 2) AS path FROM pages")
def str_commons_file(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("url", r"^https?://([^/]+)/([^?]*)", 2).alias("path"))


@query("SELECT user_id, substr(name, 1, 1) || '***@' || segment AS masked FROM users", "users")
def str_mask_email(t: Tables) -> DataFrame:
    return t.users.select("user_id", X.mask_email(F.concat("name", F.lit("@"), "segment")).alias("masked"))


@query("SELECT user_id, sha256(name) AS digest FROM users", "users")
def str_sha_hash(t: Tables) -> DataFrame:
    return t.users.select("user_id", F.sha2("name", 256).alias("digest"))


@query("SELECT conv_id, id, CASE WHEN length(content) > 40 THEN left(content, 39) || '…' ELSE content END AS short FROM messages", "messages")
def str_shorten(t: Tables) -> DataFrame:
    return t.messages.select("conv_id", "id", X.shorten(F.col("content"), 40).alias("short"))


@query("SELECT place_id, concat_ws(', ', brand, CASE WHEN indoor THEN kind END, CAST(city_id AS VARCHAR)) AS line FROM places", "places")
def str_address_format(t: Tables) -> DataFrame:
    return t.places.select("place_id", F.concat_ws(", ", "brand", F.when(F.col("indoor"), F.col("kind")), F.col("city_id").cast("string")).alias("line"))


@query(f"SELECT event_id, {LOCAL_SQL} AS day FROM usage", "usage")
def dt_local_day(t: Tables) -> DataFrame:
    return t.usage.select("event_id", local_day().alias("day"))


@query("SELECT route_id, CAST(date_trunc('month', day) AS DATE) AS month FROM routes", "routes")
def dt_month_start(t: Tables) -> DataFrame:
    return t.routes.select("route_id", F.trunc("day", "MM").alias("month"))


@query("SELECT route_id, isodow(day)::INTEGER AS dow FROM routes", "routes")
def dt_dow_iso(t: Tables) -> DataFrame:
    return t.routes.select("route_id", (F.weekday("day") + 1).alias("dow"))


@query("SELECT place_id, day, CASE WHEN closes <= opens THEN closes + 1440 ELSE closes END AS closes_at FROM opening_hours", "opening_hours")
def dt_after_midnight(t: Tables) -> DataFrame:
    return t.opening_hours.select("place_id", "day", S.closes_at(F.col("opens"), F.col("closes")).alias("closes_at"))


@query("SELECT event_id, CAST(ceil(cost / 5.0e0) * 5 AS INTEGER) AS rounded FROM usage", "usage")
def dt_round5(t: Tables) -> DataFrame:
    return t.usage.select("event_id", S.round5(F.col("cost")).alias("rounded"))


@query("SELECT place_id, CASE WHEN closes <= opens THEN closes + 1440 ELSE closes END - opens AS minutes FROM opening_hours WHERE day = 1", "opening_hours")
def dt_end_minutes(t: Tables) -> DataFrame:
    return t.opening_hours.where("day = 1").select("place_id", (S.closes_at(F.col("opens"), F.col("closes")) - F.col("opens")).alias("minutes"))


@query("SELECT route_id, CAST(day + INTERVAL 1 MONTH AS DATE) AS month_on, day + 7 AS week_on FROM routes", "routes")
def dt_calendar_add(t: Tables) -> DataFrame:
    return t.routes.select("route_id", F.add_months("day", 1).alias("month_on"), F.date_add("day", 7).alias("week_on"))


@query("SELECT event_id, CASE WHEN hour(created_at) < 11 THEN 'BREAKFAST' WHEN hour(created_at) < 15 THEN 'LUNCH' WHEN hour(created_at) < 18 THEN 'SIGHT' WHEN hour(created_at) < 22 THEN 'DINNER' ELSE 'BAR' END AS slot FROM usage", "usage")
def dt_time_bucket(t: Tables) -> DataFrame:
    h = F.hour("created_at")
    return t.usage.select("event_id", F.when(h < 11, "BREAKFAST").when(h < 15, "LUNCH").when(h < 18, "SIGHT").when(h < 22, "DINNER").otherwise("BAR").alias("slot"))


@query("SELECT route_id, day < DATE '2000-01-01' - 4 * 365 AND NOT saved AS stale FROM routes", "routes")
def dt_stale(t: Tables) -> DataFrame:
    return t.routes.select("route_id", ((F.col("day") < F.date_sub(F.lit("2000-01-01").cast("date"), 4 * 365)) & ~F.col("saved")).alias("stale"))


HAV = haversine_sql("lat", "lon", "41.0e0", "29.1e0")


@query(f"SELECT place_id, round({HAV}, 3) AS metres FROM places", "places")
def geo_haversine(t: Tables) -> DataFrame:
    return t.places.select("place_id", F.round(haversine(F.col("lat"), F.col("lon"), F.lit(41.0), F.lit(29.1)), 3).alias("metres"))


@query("SELECT place_id, CAST(ceil(popularity * 1.3e0 / 75.0e0) AS INTEGER) AS minutes FROM places", "places")
def geo_walk_minutes(t: Tables) -> DataFrame:
    return t.places.select("place_id", walk_minutes(F.col("popularity")).alias("minutes"))


@query("SELECT place_id, CAST(greatest(1, round(popularity * 1.3e0 / 80)) AS INTEGER) AS minutes FROM places", "places")
def geo_walk_minutes_web(t: Tables) -> DataFrame:
    return t.places.select("place_id", F.greatest(F.lit(1), F.round(F.col("popularity") * 1.3 / 80)).cast("int").alias("minutes"))


@query("SELECT city_id, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM places GROUP BY city_id", "places")
def geo_midpoint(t: Tables) -> DataFrame:
    return t.places.groupBy("city_id").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


@query("SELECT place_id, CAST(floor(lat / 0.0015e0) AS BIGINT) AS y, CAST(floor(lon / 0.002e0) AS BIGINT) AS x FROM places", "places")
def geo_grid_cell(t: Tables) -> DataFrame:
    from cartolake.functions.geo import cell

    return t.places.select("place_id", cell(F.col("lat"), F.col("lon")).alias("c")).select("place_id", "c.y", "c.x")


@query("SELECT floor(lat * 100 + 0.5e0) / 100 AS lat, floor(lon * 100 + 0.5e0) / 100 AS lon, count(*) AS n FROM places GROUP BY 1, 2", "places")
def geo_round_grid(t: Tables) -> DataFrame:
    return t.places.groupBy((F.floor(F.col("lat") * 100 + 0.5) / 100).alias("lat"), (F.floor(F.col("lon") * 100 + 0.5) / 100).alias("lon")).agg(F.count("*").alias("n"))


@query("SELECT place_id, lon > 29.05e0 AND lon < 29.15e0 - abs(lat - 41.0e0) AND lat > 40.95e0 AND lat < 41.05e0 AS inside FROM places WHERE abs(lat - 40.95e0) > 1e-9 AND abs(lat - 41.05e0) > 1e-9 AND abs(lon - 29.05e0) > 1e-9 AND abs(lon - 29.15e0 + abs(lat - 41.0e0)) > 1e-9", "places")
def flt_point_in_polygon(t: Tables) -> DataFrame:
    """Even-odd rule over a five-sided ring; points on its edge are left out on both sides."""
    corners = [(29.05, 40.95), (29.10, 40.95), (29.15, 41.0), (29.10, 41.05), (29.05, 41.05), (29.05, 40.95)]
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in corners])
    lat, lon = F.col("lat"), F.col("lon")
    off = [F.abs(lat - 40.95), F.abs(lat - 41.05), F.abs(lon - 29.05), F.abs(lon - 29.15 + F.abs(lat - 41.0))]
    p = t.places
    for d in off:
        p = p.where(d > 1e-9)
    return p.select("place_id", in_ring(lat, lon, ring).alias("inside"))


@query("SELECT place_id, round(greatest(0, 2 * ln(1 + place_id) + ln(1 + popularity)), 6) AS score FROM places", "places")
def num_popularity(t: Tables) -> DataFrame:
    return t.places.select("place_id", F.round(F.greatest(F.lit(0), 2 * F.log1p("place_id") + F.log1p("popularity")), 6).alias("score"))


@query("SELECT place_id, CASE WHEN source = 'VERIFIED' THEN 3 ELSE 0 END + least(greatest(coalesce(rating, 3) - 3, 0), 2) + CASE WHEN has_image THEN 1 ELSE 0 END AS score FROM places", "places")
def num_fallback_score(t: Tables) -> DataFrame:
    extra = F.least(F.greatest(F.coalesce("rating", F.lit(3.0)) - 3, F.lit(0.0)), F.lit(2.0))
    return t.places.select("place_id", (F.when(F.col("source") == "VERIFIED", 3).otherwise(0) + extra + F.when(F.col("has_image"), 1).otherwise(0)).alias("score"))


@query("SELECT event_id, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) * 400 / 1000000.0e0 AS DOUBLE) AS dollars FROM usage", "usage")
def num_ai_cost(t: Tables) -> DataFrame:
    return t.usage.select("event_id", (F.get_json_object("props", "$.k").cast("long") * 400 / 1000000.0).alias("dollars"))


def tagged(expression):
    return lambda t: t.places.select("place_id", F.array_join(expression(), ",").alias("tags"))


query("SELECT place_id, array_to_string(CASE WHEN list_contains(tags, 'small') THEN tags ELSE list_append(tags, 'small') END, ',') AS tags FROM places", "places", "arr_append_guarded")(
    tagged(lambda: F.when(F.array_contains("tags", "small"), F.col("tags")).otherwise(F.array_append("tags", F.lit("small"))))
)
query("SELECT place_id, array_to_string(list_filter(tags, lambda x: x <> 'widget'), ',') AS tags FROM places", "places", "arr_remove")(tagged(lambda: F.array_remove("tags", "widget")))
query("SELECT place_id, array_to_string(CASE WHEN list_contains(tags, 'gear') THEN tags ELSE list_append(tags, 'gear') END, ',') AS tags FROM places", "places", "arr_merge_stable")(
    tagged(lambda: F.array_distinct(F.concat(F.col("tags"), F.array(F.lit("gear")))))
)
query("SELECT place_id, array_to_string(split(array_to_string(tags, ';'), ';'), ',') AS tags FROM places", "places", "arr_to_string")(tagged(lambda: F.split(F.array_join("tags", ";"), ";")))


@query("SELECT place_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM places", "places")
def arr_unnest_pos(t: Tables) -> DataFrame:
    return t.places.select("place_id", F.posexplode("tags").alias("at", "tag")).select("place_id", "tag", (F.col("at") + 1).cast("long").alias("pos"))


@query("SELECT place_id, array_to_string(list_transform(range(1, len(tags) + 1), lambda i: i || ':' || tags[i]), ',') AS zipped FROM places", "places")
def arr_zip_index(t: Tables) -> DataFrame:
    return t.places.select("place_id", F.array_join(F.transform("tags", lambda x, i: F.concat_ws(":", i + 1, x)), ",").alias("zipped"))


@query("SELECT place_id, tags[1] AS first, tags[3] AS third FROM places", "places")
def arr_index(t: Tables) -> DataFrame:
    return t.places.select("place_id", F.try_element_at("tags", F.lit(1)).alias("first"), F.try_element_at("tags", F.lit(3)).alias("third"))


@query("SELECT place_id, len(tags)::INTEGER AS n FROM places WHERE len(tags) > 0", "places")
def arr_cardinality(t: Tables) -> DataFrame:
    return t.places.where(F.size("tags") > 0).select("place_id", F.size("tags").alias("n"))


#: Interests and the tags that serve them.
INTERESTS = {"craft": ["gear", "tool"], "cosy": ["small", "soft"], "winter": ["cold"]}


@query(
    "SELECT place_id, concat_ws(',', " + ", ".join(f"CASE WHEN list_has_any(tags, {v}) THEN '{k}' END" for k, v in INTERESTS.items()) + ") AS interests FROM places",
    "places",
)
def arr_interest_match(t: Tables) -> DataFrame:
    met = [F.when(F.arrays_overlap("tags", F.array(*[F.lit(x) for x in v])), F.lit(k)) for k, v in INTERESTS.items()]
    return t.places.select("place_id", F.concat_ws(",", *met).alias("interests"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def map_get(t: Tables) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", m["k"].cast("long").alias("k"), F.try_element_at(m, F.lit("none")).alias("missing"))


@query("SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL OR json_extract_string(props, '$.z') IS NOT NULL AS has FROM events")
def map_any_key(t: Tables) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", F.exists(F.array(F.lit("k"), F.lit("z")), lambda k: F.trim(F.try_element_at(m, k)) != "").alias("has")).na.fill(False)


@query("""SELECT place_id, '{"id":' || place_id || ',"name":"' || name || '"}' AS doc FROM places""", "places")
def json_to(t: Tables) -> DataFrame:
    return t.places.select("place_id", F.to_json(F.struct(F.col("place_id").alias("id"), "name")).alias("doc"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_from(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))
