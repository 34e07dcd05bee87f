"""Changes to stored relations, as the state after them (inventory 2.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.operators.relational import beyond, first_per, upsert
from cartolake.plans.registry import query
from cartolake.sources.tables import Tables

OLD = "SELECT place_id, name, source, hidden, rating FROM places WHERE source <> 'VERIFIED' OR indoor"
NEW = "SELECT place_id, upper(name) AS name, CASE WHEN place_id % 5 = 0 THEN NULL ELSE 4.5e0 END AS rating FROM places WHERE source <> 'OSM' OR has_image"


def old(t: Tables) -> DataFrame:
    return t.places.where("source <> 'VERIFIED' OR indoor").select("place_id", "name", "source", "hidden", "rating")


def new(t: Tables) -> DataFrame:
    return t.places.where("source <> 'OSM' OR has_image").select("place_id", F.upper("name").alias("name"), F.when(F.col("place_id") % 5 != 0, 4.5).alias("rating"))


@query(
    f", o AS ({OLD}), n AS ({NEW}) SELECT coalesce(n.place_id, o.place_id) AS place_id, CASE WHEN n.place_id IS NOT NULL AND (o.place_id IS NULL OR o.source = 'OSM') THEN n.name ELSE o.name END AS name, o.source, o.hidden, CASE WHEN n.place_id IS NOT NULL AND (o.place_id IS NULL OR o.source = 'OSM') THEN n.rating ELSE o.rating END AS rating FROM o FULL JOIN n ON o.place_id = n.place_id",
    "places",
)
def snk_upsert_osm(t: Tables) -> DataFrame:
    """Insert or update; rows of another source stay as they are."""
    return upsert(old(t), new(t), "place_id", guard=F.col("o.source") == "OSM")


@query(
    f", o AS ({OLD}), n AS ({NEW}) SELECT coalesce(n.place_id, o.place_id) AS place_id, coalesce(n.name, o.name) AS name, o.source, CASE WHEN n.place_id IS NOT NULL THEN FALSE ELSE o.hidden END AS hidden, CASE WHEN n.place_id IS NOT NULL THEN n.rating ELSE o.rating END AS rating FROM o FULL JOIN n ON o.place_id = n.place_id",
    "places",
)
def snk_upsert_overture(t: Tables) -> DataFrame:
    """Insert or update; what is delivered again is shown again."""
    return upsert(old(t), new(t), "place_id", update={"hidden": F.lit(False)})


@query(
    f", o AS ({OLD}), n AS ({NEW}) SELECT coalesce(n.place_id, o.place_id) AS place_id, coalesce(n.name, o.name) AS name, o.source, o.hidden, coalesce(n.rating, o.rating) AS rating FROM o FULL JOIN n ON o.place_id = n.place_id",
    "places",
)
def snk_upsert_coalesce(t: Tables) -> DataFrame:
    return upsert(old(t), new(t), "place_id", update={"rating": F.coalesce("n.rating", "o.rating")})


@query("SELECT place_id, arg_max(reason, (created_at, report_id)) AS reason FROM reports GROUP BY place_id", "reports")
def snk_upsert_simple(t: Tables) -> DataFrame:
    return first_per(t.reports, ["place_id"], [F.desc("created_at"), F.desc("report_id")]).select("place_id", "reason")


@query("SELECT l_partkey AS place_id, o_custkey AS user_id, arg_max(1 + CAST(floor(l_quantity) AS INT) % 5, (o_orderdate, o_orderkey, l_linenumber, l_quantity)) AS stars FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def snk_upsert_rating(t: Tables) -> DataFrame:
    r = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    stars = (1 + F.floor("l_quantity").cast("int") % 5).alias("stars")
    r = r.select(F.col("l_partkey").alias("place_id"), F.col("o_custkey").alias("user_id"), stars, F.struct("o_orderdate", "o_orderkey", "l_linenumber", "l_quantity").alias("at"))
    return r.groupBy("place_id", "user_id").agg(F.max_by("stars", "at").alias("stars"))


@query("SELECT place_id, vote FROM (SELECT place_id, arg_max(report_id % 3 - 1, (created_at, report_id)) AS vote FROM reports GROUP BY place_id) x WHERE vote <> 0", "reports")
def snk_upsert_vote(t: Tables) -> DataFrame:
    """The last vote of each key; a zero takes it back."""
    return t.reports.groupBy("place_id").agg(F.max_by(F.col("report_id") % 3 - 1, F.struct("created_at", "report_id")).alias("vote")).where("vote <> 0")


@query("SELECT user_id, arg_max(liked, (updated_at, route_id)) AS liked FROM routes JOIN route_feedback USING (route_id) GROUP BY user_id", "routes route_feedback")
def snk_upsert_feedback(t: Tables) -> DataFrame:
    return t.routes.join(t.route_feedback, "route_id").groupBy("user_id").agg(F.max_by("liked", F.struct("updated_at", "route_id")).alias("liked"))


@query("SELECT place_id, reason, max(created_at) AS created_at, FALSE AS resolved FROM reports GROUP BY place_id, reason", "reports")
def snk_upsert_report(t: Tables) -> DataFrame:
    return t.reports.groupBy("place_id", "reason").agg(F.max("created_at").alias("created_at")).withColumn("resolved", F.lit(False))


@query("SELECT place_id, min(user_id) AS user_id FROM saved_places GROUP BY place_id", "saved_places")
def snk_insert_ignore(t: Tables) -> DataFrame:
    """First one in stays."""
    return first_per(t.saved_places, ["place_id"], [F.col("user_id")]).select("place_id", "user_id")


@query(
    "SELECT p.place_id, coalesce(r.mean, 0) AS mean FROM places p LEFT JOIN (SELECT place_id, round(avg(stars), 1) AS mean FROM place_ratings GROUP BY place_id) r USING (place_id) WHERE coalesce(r.mean, 0) IS DISTINCT FROM p.rating",
    "places place_ratings",
)
def snk_update_from(t: Tables) -> DataFrame:
    """Only the rows whose value changes."""
    r = t.place_ratings.groupBy("place_id").agg(F.round(F.avg("stars"), 1).alias("mean"))
    joined = t.places.join(r, "place_id", "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    return joined.where(~F.col("mean").eqNullSafe(F.col("rating"))).select("place_id", "mean")


@query("SELECT report_id, reason FROM (SELECT *, row_number() OVER (PARTITION BY place_id, reason ORDER BY created_at DESC, report_id DESC) AS n FROM reports) x WHERE n > 2", "reports")
def snk_delete_returning(t: Tables) -> DataFrame:
    return beyond(t.reports, ["place_id", "reason"], [F.desc("created_at"), F.desc("report_id")], 2).select("report_id", "reason")


@query("SELECT place_id, day, opens, closes FROM opening_hours WHERE place_id NOT IN (SELECT place_id FROM places WHERE has_image) UNION ALL SELECT place_id, 1, 600, 1200 FROM places WHERE has_image", "opening_hours places")
def snk_replace_children(t: Tables) -> DataFrame:
    parents = t.places.where("has_image").select("place_id")
    fresh = parents.select("place_id", F.lit(1).alias("day"), F.lit(600).alias("opens"), F.lit(1200).alias("closes"))
    return t.opening_hours.join(parents, "place_id", "left_anti").select("place_id", "day", "opens", "closes").unionByName(fresh)


@query("SELECT route_id, CASE WHEN status IN ('DRAFT', 'ACTIVE') AND day < DATE '1998-01-01' THEN 'EXPIRED' ELSE status END AS status FROM routes", "routes")
def snk_expire(t: Tables) -> DataFrame:
    due = F.col("status").isin("DRAFT", "ACTIVE") & (F.col("day") < F.lit("1998-01-01").cast("date"))
    return t.routes.select("route_id", F.when(due, "EXPIRED").otherwise(F.col("status")).alias("status"))


@query(
    "SELECT a.city_id, CASE WHEN b.city_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM districts d WHERE d.district_id = a.city_id + 1000) THEN a.city_id + 1000 ELSE a.city_id END AS new_id FROM cities a LEFT JOIN cities b ON b.name = a.name AND b.region_id = 2",
    "cities districts",
)
def snk_rekey(t: Tables) -> DataFrame:
    b = t.cities.where("region_id = 2").select("name", F.lit(True).alias("known"))
    taken = t.districts.select((F.col("district_id") - 1000).alias("city_id"), F.lit(True).alias("taken"))
    j = t.cities.join(b, "name", "left").join(taken, "city_id", "left")
    return j.select("city_id", F.when(F.col("known") & F.col("taken").isNull(), F.col("city_id") + 1000).otherwise(F.col("city_id")).alias("new_id"))


@query("SELECT route_id, CASE WHEN status = 'ACTIVE' AND route_id IN (SELECT report_id FROM reports WHERE reason = 'error') THEN 'REVOKED' ELSE status END AS status FROM routes", "routes reports")
def snk_revoke_voided(t: Tables) -> DataFrame:
    void = t.reports.where("reason = 'error'").select(F.col("report_id").alias("route_id"), F.lit(True).alias("void"))
    return t.routes.join(void, "route_id", "left").select("route_id", F.when((F.col("status") == "ACTIVE") & F.col("void"), "REVOKED").otherwise(F.col("status")).alias("status"))


@query("SELECT photo_id, quality = 0 AS cleared FROM photos WHERE NOT (toxic = 1 AND photo_id % 2 = 0)", "photos")
def snk_photo_retention(t: Tables) -> DataFrame:
    return t.photos.where("NOT (toxic = 1 AND photo_id % 2 = 0)").select("photo_id", (F.col("quality") == 0).alias("cleared"))


@query("SELECT a.place_id, b.place_id AS takes FROM places a JOIN places b ON b.place_id = a.place_id + CASE WHEN a.place_id % 2 = 0 THEN 1 ELSE -1 END", "places")
def snk_id_handover(t: Tables) -> DataFrame:
    """Neighbours swap ids; the state after it is one join, so no id is taken twice on the way."""
    a = t.places.select("place_id", (F.col("place_id") + F.when(F.col("place_id") % 2 == 0, 1).otherwise(-1)).alias("takes"))
    return a.join(t.places.select(F.col("place_id").alias("takes")), "takes", "left_semi").select("place_id", "takes")


@query(
    "SELECT place_id, EXISTS (SELECT 1 FROM saved_places s WHERE s.place_id = p.place_id) OR EXISTS (SELECT 1 FROM route_stops x WHERE x.place_id = p.place_id) AS kept_hidden FROM places p WHERE hidden OR review IS NOT NULL",
    "places saved_places route_stops",
)
def snk_delete_unreferenced(t: Tables) -> DataFrame:
    """Of all rows marked for removal: referenced ones are hidden, the others deleted."""
    used = t.saved_places.select("place_id").union(t.route_stops.select("place_id")).distinct().withColumn("kept_hidden", F.lit(True))
    return t.places.where("hidden OR review IS NOT NULL").select("place_id").join(used, "place_id", "left").na.fill(False)
