"""Per-group selection and running state (inventory 2.7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolake.functions.geo import haversine, haversine_sql
from cartolake.operators.relational import beyond, first_per
from cartolake.plans.registry import query
from cartolake.sources.tables import Tables


@query("SELECT conv_id, id, role, length(content) AS size FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS n FROM messages) x WHERE n = 1", "messages")
def win_distinct_on(t: Tables) -> DataFrame:
    return first_per(t.messages, ["conv_id"], [F.desc("id")]).select("conv_id", "id", "role", F.length("content").cast("long").alias("size"))


@query("SELECT user_id, arg_max(route_id, (day, route_id)) AS route_id FROM routes GROUP BY user_id", "routes")
def win_correlated_latest(t: Tables) -> DataFrame:
    return t.routes.groupBy("user_id").agg(F.max_by("route_id", F.struct("day", "route_id")).alias("route_id"))


@query("SELECT report_id FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY created_at DESC, report_id DESC) AS n FROM reports) x WHERE n > 5", "reports")
def win_offset_prune(t: Tables) -> DataFrame:
    return beyond(t.reports, ["place_id"], [F.desc("created_at"), F.desc("report_id")], 5).select("report_id")


STACKED = """WITH RECURSIVE p AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase'),
 r AS (SELECT event_id, user_id, n, ts AS starts, ts + INTERVAL 7 DAY AS ends FROM p WHERE n = 1
 UNION ALL SELECT p.event_id, p.user_id, p.n, greatest(p.ts, r.ends), greatest(p.ts, r.ends) + INTERVAL 7 DAY FROM r JOIN p ON p.user_id = r.user_id AND p.n = r.n + 1)"""


@query(STACKED + " SELECT event_id, user_id, starts, ends FROM r")
def win_stack_passes(t: Tables) -> DataFrame:
    """Each pass starts when it is bought or when the one before ends, for 7 days.

    With k passes before it, a pass ends at max over earlier-or-same i of (bought_i + 7 days x passes from i on): a running
    maximum, so hot users need no fold over their whole list.
    """
    week = 7 * 86_400_000_000
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.row_number().over(w)
    bought = t.events.where("event_type = 'purchase'").withColumn("n", n.cast("long")).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    ends = F.max(F.col("at") - F.col("n") * week).over(w) + (F.col("n") + 1) * week
    return bought.withColumn("end", ends).select("event_id", "user_id", F.timestamp_micros(F.col("end") - week).cast("timestamp_ntz").alias("starts"), F.timestamp_micros("end").cast("timestamp_ntz").alias("ends"))


@query(STACKED + " SELECT user_id, max(ends) AS last_end, count(*) AS passes FROM r GROUP BY user_id")
def win_current_pass(t: Tables) -> DataFrame:
    return win_stack_passes(t).groupBy("user_id").agg(F.max("ends").alias("last_end"), F.count("*").alias("passes"))


@query(
    """, s AS (SELECT user_id, created_at AS a, created_at + INTERVAL 2 HOUR AS b FROM usage), f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT user_id, min(a) AS starts, max(b) AS ends, count(*) AS parts FROM g GROUP BY user_id, run""",
    "usage",
)
def win_merge_intervals(t: Tables) -> DataFrame:
    """Touching intervals merged: a new run starts where no earlier interval of the key reaches."""
    rows = t.usage.select("user_id", F.col("created_at").alias("a"), (F.col("created_at") + F.expr("INTERVAL 2 HOURS")).alias("b"))
    w = Window.partitionBy("user_id").orderBy("a", "b")
    fresh = F.when(F.col("a") <= F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    runs = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("user_id", "run").agg(F.min("a").alias("starts"), F.max("b").alias("ends"), F.count("*").alias("parts")).drop("run")


LEG = haversine_sql("lat", "lon", "lag(lat) OVER w", "lag(lon) OVER w")


@query(f"SELECT route_id, position, round({LEG}, 1) AS leg FROM route_stops JOIN places USING (place_id) WINDOW w AS (PARTITION BY route_id ORDER BY position)", "route_stops places")
def win_leg_distance(t: Tables) -> DataFrame:
    """Metres from the stop before; a route's first stop has none."""
    w = Window.partitionBy("route_id").orderBy("position")
    stops = t.route_stops.join(t.places.select("place_id", "lat", "lon"), "place_id")
    return stops.select("route_id", "position", F.round(haversine(F.col("lat"), F.col("lon"), F.lag("lat").over(w), F.lag("lon").over(w)), 1).alias("leg"))


@query(
    "SELECT route_id, string_agg(lower(to_base(place_id, 36)), '-' ORDER BY position) AS key FROM route_stops WHERE NOT skipped GROUP BY route_id",
    "route_stops",
)
def win_sequence_key(t: Tables) -> DataFrame:
    stops = F.array_sort(F.collect_list(F.struct("position", "place_id")))
    return t.route_stops.where("NOT skipped").groupBy("route_id").agg(F.array_join(F.transform(stops, lambda s: F.lower(F.conv(s["place_id"].cast("string"), 10, 36))), "-").alias("key"))


@query(
    "SELECT user_id, arg_max(route_id, (day, route_id)) AS route_id FROM routes r WHERE status IN ('DRAFT', 'ACTIVE') AND EXISTS (SELECT 1 FROM route_stops s WHERE s.route_id = r.route_id) GROUP BY user_id",
    "routes route_stops",
)
def win_current_route(t: Tables) -> DataFrame:
    live = t.routes.where("status IN ('DRAFT', 'ACTIVE')").join(t.route_stops, "route_id", "left_semi")
    return first_per(live, ["user_id"], [F.desc("day"), F.desc("route_id")]).select("user_id", "route_id")


@query(
    "SELECT conv_id, max(id) AS last_id, left(arg_max(content, id), 40) AS preview FROM messages GROUP BY conv_id ORDER BY last_id DESC, conv_id LIMIT 20",
    "messages",
)
def win_conversation_list(t: Tables) -> DataFrame:
    last = t.messages.groupBy("conv_id").agg(F.max("id").alias("last_id"), F.left(F.max_by("content", "id"), F.lit(40)).alias("preview"))
    return last.orderBy(F.desc("last_id"), "conv_id").limit(20)


@query(
    "SELECT route_id, CASE WHEN 700 - m BETWEEN 15 AND 180 THEN 700 - m ELSE 0 END AS behind FROM (SELECT route_id, arg_min(480 + place_id % 480, position) FILTER (NOT skipped) AS m FROM route_stops GROUP BY route_id) x WHERE m IS NOT NULL",
    "route_stops",
)
def win_first_gap(t: Tables) -> DataFrame:
    first = t.route_stops.where("NOT skipped").groupBy("route_id").agg(F.min_by(480 + F.col("place_id") % 480, "position").alias("m"))
    late = 700 - F.col("m")
    return first.select("route_id", F.when(late.between(15, 180), late).otherwise(0).alias("behind"))


@query("SELECT (route_id % 2000000) * 100 + position AS reminder_id, 480 + place_id % 480 - 10 AS at FROM route_stops WHERE NOT skipped AND 480 + place_id % 480 - 10 > 600", "route_stops")
def win_reminders(t: Tables) -> DataFrame:
    at = 480 + F.col("place_id") % 480 - 10
    return t.route_stops.where(~F.col("skipped") & (at > 600)).select(((F.col("route_id") % 2000000) * 100 + F.col("position")).alias("reminder_id"), at.alias("at"))
