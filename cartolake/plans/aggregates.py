"""Aggregations (inventory 2.6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.plans.registry import query
from cartolake.sources.tables import Tables

ZONE = "Europe/Istanbul"


def local_day(c: str = "created_at"):
    return F.to_date(F.from_utc_timestamp(c, ZONE))


#: Istanbul has been three hours ahead of UTC all year round since 2016.
LOCAL_SQL = "CAST(created_at + INTERVAL 3 HOUR AS DATE)"


@query("SELECT count(*) FILTER (hidden) AS hidden, count(*) FILTER (rating IS NULL) AS unrated, count(*) AS n FROM places", "places")
def agg_count_where(t: Tables) -> DataFrame:
    return t.places.agg(F.count_if("hidden").alias("hidden"), F.count_if(F.col("rating").isNull()).alias("unrated"), F.count("*").alias("n"))


@query("SELECT reason, count(*) AS n FROM rating_reasons GROUP BY reason", "rating_reasons")
def agg_group_count(t: Tables) -> DataFrame:
    return t.rating_reasons.groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "SELECT p.place_id, coalesce(sum(stars), 0)::BIGINT AS total, count(stars) AS n FROM places p LEFT JOIN place_ratings r USING (place_id) GROUP BY p.place_id",
    "places place_ratings",
)
def agg_sum_count(t: Tables) -> DataFrame:
    r = t.place_ratings.groupBy("place_id").agg(F.sum("stars").alias("total"), F.count("*").alias("n"))
    return t.places.select("place_id").join(r, "place_id", "left").select("place_id", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("SELECT place_id, count(*) AS saves FROM saved_places GROUP BY place_id", "saved_places")
def agg_saves_count(t: Tables) -> DataFrame:
    return t.saved_places.groupBy("place_id").agg(F.count("*").alias("saves"))


@query("SELECT kind, count(*) AS calls, count(*) FILTER (NOT ok) AS failed, round(sum(cost), 2) AS cost FROM usage GROUP BY kind", "usage")
def agg_filter(t: Tables) -> DataFrame:
    return t.usage.groupBy("kind").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.sum("cost"), 2).alias("cost"))


@query(
    "SELECT p.city_id, count(*) FILTER (stars >= 4) AS likes, count(*) FILTER (stars <= 2) AS dislikes, coalesce(max(stars) FILTER (user_id = 1), 0) AS mine FROM place_ratings JOIN places p USING (place_id) GROUP BY p.city_id",
    "places place_ratings",
)
def agg_filter_pivot(t: Tables) -> DataFrame:
    r = t.place_ratings.join(t.places.select("place_id", "city_id"), "place_id")
    mine = F.coalesce(F.max(F.when(F.col("user_id") == 1, F.col("stars"))), F.lit(0))
    return r.groupBy("city_id").agg(F.count_if(F.col("stars") >= 4).alias("likes"), F.count_if(F.col("stars") <= 2).alias("dislikes"), mine.alias("mine"))


@query(f"SELECT {LOCAL_SQL} AS day, count(*) AS calls, round(sum(cost), 2) AS cost FROM usage WHERE created_at >= TIMESTAMP '2024-01-05' GROUP BY 1", "usage")
def agg_daily(t: Tables) -> DataFrame:
    return t.usage.where("created_at >= '2024-01-05'").groupBy(local_day().alias("day")).agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 2).alias("cost"))


@query(
    "SELECT user_id, round(sum(cost), 2) AS cost, count(*) AS calls FROM usage WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY round(sum(cost), 2) DESC, count(*) DESC, user_id LIMIT 10",
    "usage",
)
def agg_top_users(t: Tables) -> DataFrame:
    u = t.usage.where("user_id IS NOT NULL").groupBy("user_id").agg(F.round(F.sum("cost"), 2).alias("cost"), F.count("*").alias("calls"))
    return u.orderBy(F.desc("cost"), F.desc("calls"), "user_id").limit(10)


@query(
    f"SELECT count(*) FILTER ({LOCAL_SQL} = DATE '2024-01-20') AS today, count(*) FILTER ({LOCAL_SQL} >= DATE '2024-01-01') AS month, round(sum(cost) FILTER ({LOCAL_SQL} >= DATE '2024-01-01'), 2) AS month_cost FROM usage",
    "usage",
)
def agg_totals_period(t: Tables) -> DataFrame:
    in_month = local_day() >= F.trunc(F.lit("2024-01-20").cast("date"), "MM")
    return t.usage.agg(
        F.count_if(local_day() == F.lit("2024-01-20").cast("date")).alias("today"), F.count_if(in_month).alias("month"), F.round(F.sum(F.when(in_month, F.col("cost"))), 2).alias("month_cost")
    )


@query("SELECT sum(cost) >= 100000 AS reached FROM usage", "usage")
def agg_budget_reached(t: Tables) -> DataFrame:
    return t.usage.agg((F.sum("cost") >= 100000).alias("reached"))


@query("SELECT place_id, arg_max(reason, (created_at, report_id)) AS last_reason FROM reports GROUP BY place_id", "reports")
def agg_array_ordered_first(t: Tables) -> DataFrame:
    return t.reports.groupBy("place_id").agg(F.max_by("reason", F.struct("created_at", "report_id")).alias("last_reason"))


@query(
    "SELECT place_id, count(*) AS n, arg_max(reason, (created_at, report_id)) AS last_reason, max(created_at) AS last_at FROM reports WHERE NOT resolved GROUP BY place_id", "reports"
)
def agg_open_reports(t: Tables) -> DataFrame:
    latest = F.max_by("reason", F.struct("created_at", "report_id"))
    return t.reports.where("NOT resolved").groupBy("place_id").agg(F.count("*").alias("n"), latest.alias("last_reason"), F.max("created_at").alias("last_at"))


@query("SELECT route_id, string_agg(CAST(place_id AS VARCHAR), ',' ORDER BY position) AS stops FROM route_stops GROUP BY route_id", "route_stops")
def agg_list_ordered(t: Tables) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("position", "place_id")))
    return t.route_stops.groupBy("route_id").agg(F.array_join(F.transform(ordered, lambda s: s["place_id"].cast("string")), ",").alias("stops"))


@query(
    """SELECT route_id, '[' || string_agg('{"p":' || position || ',"id":' || place_id || '}', ',' ORDER BY position) || ']' AS stops FROM route_stops GROUP BY route_id""",
    "route_stops",
)
def agg_list_struct_json(t: Tables) -> DataFrame:
    return t.route_stops.groupBy("route_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("position").alias("p"), F.col("place_id").alias("id"))))).alias("stops"))


@query("SELECT city_id, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM places GROUP BY city_id", "places")
def agg_bbox(t: Tables) -> DataFrame:
    return t.places.groupBy("city_id").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))


@query("SELECT count(DISTINCT place_id) AS places, count(DISTINCT reason) AS reasons FROM reports", "reports")
def agg_count_distinct(t: Tables) -> DataFrame:
    return t.reports.agg(F.countDistinct("place_id").alias("places"), F.countDistinct("reason").alias("reasons"))


@query("SELECT DISTINCT city_id, category FROM places", "places")
def agg_distinct(t: Tables) -> DataFrame:
    return t.places.select("city_id", "category").distinct()


@query("SELECT (SELECT count(*) FROM places WHERE hidden) AS hidden, (SELECT count(*) FROM reports WHERE NOT resolved) AS open, (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM routes WHERE saved) AS saved", "places reports users routes")
def agg_multi_scalar(t: Tables) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))  # noqa: E731  a row each, so the product is a row
    return one(t.places.where("hidden"), "hidden").crossJoin(one(t.reports.where("NOT resolved"), "open")).crossJoin(one(t.users, "users")).crossJoin(one(t.routes.where("saved"), "saved"))


@query(
    "SELECT c.city_id, (SELECT count(*) FROM places p WHERE p.city_id = c.city_id) AS places, (SELECT count(*) FROM districts d WHERE d.city_id = c.city_id) AS districts FROM cities c",
    "cities places districts",
)
def agg_correlated_count(t: Tables) -> DataFrame:
    p = t.places.groupBy("city_id").agg(F.count("*").alias("places"))
    d = t.districts.groupBy("city_id").agg(F.count("*").alias("districts"))
    return t.cities.select("city_id").join(p, "city_id", "left").join(d, "city_id", "left").na.fill(0)


@query("SELECT user_id, min(day) AS first_day, max(day) AS last_day, arg_max(route_id, (day, route_id)) FILTER (status = 'ACTIVE') AS latest FROM routes GROUP BY user_id", "routes")
def agg_min_max_time(t: Tables) -> DataFrame:
    latest = F.max(F.when(F.col("status") == "ACTIVE", F.struct("day", "route_id")))["route_id"]
    return t.routes.groupBy("user_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), latest.alias("latest"))


@query(
    """, k AS (SELECT route_id, string_agg(CAST(place_id AS VARCHAR), '-' ORDER BY position) AS key FROM route_stops WHERE NOT skipped GROUP BY route_id)
    SELECT key, sum(CASE WHEN liked THEN 1 ELSE -1 END)::BIGINT AS net, arg_max(route_id, (updated_at, route_id)) FILTER (liked) AS face FROM k JOIN route_feedback USING (route_id)
    GROUP BY key HAVING sum(CASE WHEN liked THEN 1 ELSE -1 END) > 0 ORDER BY net DESC, key LIMIT 10""",
    "route_stops route_feedback",
)
def agg_net_likes(t: Tables) -> DataFrame:
    stops = F.array_sort(F.collect_list(F.struct("position", "place_id")))
    keys = t.route_stops.where("NOT skipped").groupBy("route_id").agg(F.array_join(F.transform(stops, lambda s: s["place_id"].cast("string")), "-").alias("key"))
    votes = keys.join(t.route_feedback, "route_id").groupBy("key").agg(
        F.sum(F.when(F.col("liked"), 1).otherwise(-1)).alias("net"), F.max(F.when(F.col("liked"), F.struct("updated_at", "route_id")))["route_id"].alias("face")
    )
    return votes.where("net > 0").orderBy(F.desc("net"), "key").limit(10)


@query(
    """, v AS (SELECT place_id, reason, count(*) AS n FROM rating_reasons GROUP BY place_id, reason), r AS (SELECT place_id, count(DISTINCT user_id) AS raters FROM rating_reasons GROUP BY place_id)
    SELECT v.place_id, v.reason FROM v JOIN r USING (place_id) LEFT JOIN v o ON o.place_id = v.place_id AND o.reason = v.reason + 1 AND v.reason % 2 = 1
    WHERE v.reason % 2 = 1 AND v.n - coalesce(o.n, 0) >= 3 AND v.n * 3 >= r.raters""",
    "rating_reasons",
)
def agg_community_tags(t: Tables) -> DataFrame:
    """A reason (odd) becomes a tag if it leads its opposite (the next even one) by 3 and a third of the raters give it."""
    pair = F.floor((F.col("reason") - 1) / 2)
    votes = t.rating_reasons.groupBy("place_id", pair.alias("pair")).agg(F.count_if(F.col("reason") % 2 == 1).alias("pro"), F.count_if(F.col("reason") % 2 == 0).alias("con"))
    raters = t.rating_reasons.groupBy("place_id").agg(F.countDistinct("user_id").alias("raters"))
    return votes.join(raters, "place_id").where("pro - con >= 3 AND pro * 3 >= raters").select("place_id", (F.col("pair") * 2 + 1).cast("int").alias("reason"))


@query(
    "SELECT place_id, reason, n FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY n DESC, reason) AS k FROM (SELECT place_id, reason, count(*) AS n FROM rating_reasons GROUP BY place_id, reason HAVING count(*) >= 2) v) x WHERE k <= 6",
    "rating_reasons",
)
def agg_reason_top(t: Tables) -> DataFrame:
    from cartolake.operators.relational import first_per

    votes = t.rating_reasons.groupBy("place_id", "reason").agg(F.count("*").alias("n")).where("n >= 2")
    return first_per(votes, ["place_id"], [F.desc("n"), F.col("reason")], 6)


@query(
    """SELECT date_trunc('hour', created_at) AS hour, max(cost) AS max_temp, min(cost) AS min_temp, bool_or(kind = 'error') AS any_wet, bool_and(cost < 400) AS all_cold, arg_max(kind, (cost, event_id)) AS worst
    FROM usage GROUP BY 1""",
    "usage",
)
def agg_weather_summary(t: Tables) -> DataFrame:
    return t.usage.groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour")).agg(
        F.max("cost").alias("max_temp"), F.min("cost").alias("min_temp"), F.bool_or(F.col("kind") == "error").alias("any_wet"), F.bool_and(F.col("cost") < 400).alias("all_cold"), F.max_by("kind", F.struct("cost", "event_id")).alias("worst")
    )


@query("SELECT s.route_id, count(*) AS stops, sum(p.cost)::BIGINT AS total, count(*) FILTER (p.cost IS NULL) AS unknown FROM route_stops s JOIN places p USING (place_id) GROUP BY s.route_id", "route_stops places")
def agg_route_totals(t: Tables) -> DataFrame:
    """Unknown prices are counted, not summed; a route of unknown prices has no total."""
    return t.route_stops.join(t.places.select("place_id", "cost"), "place_id").groupBy("route_id").agg(F.count("*").alias("stops"), F.sum("cost").alias("total"), F.count_if(F.col("cost").isNull()).alias("unknown"))


@query("SELECT source, count(*) AS n, count(*) FILTER (hidden) AS hidden FROM places GROUP BY source", "places")
def agg_import_stats(t: Tables) -> DataFrame:
    return t.places.groupBy("source").agg(F.count("*").alias("n"), F.count_if("hidden").alias("hidden"))


@query(
    "SELECT event_id, (SELECT count(*) FROM usage u WHERE u.user_id = e.user_id AND u.created_at > e.created_at - INTERVAL 24 HOUR AND u.created_at < e.created_at) AS used FROM usage e WHERE kind = 'purchase'",
    "usage",
)
def agg_quota_24h(t: Tables) -> DataFrame:
    """Earlier events of the user in the 24 hours before, by a range window over microseconds."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("created_at").cast("timestamp"))).rangeBetween(-24 * 3_600_000_000 + 1, -1)
    return t.usage.withColumn("used", F.count("*").over(w)).where("kind = 'purchase'").select("event_id", "used")
