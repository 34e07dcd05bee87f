"""Set operations (inventory 2.9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.functions.text import jaccard
from cartolake.operators.relational import first_per
from cartolake.plans.registry import query
from cartolake.sources.tables import Tables


@query("SELECT place_id AS id, 'place' AS what FROM places WHERE has_image UNION ALL SELECT photo_id, 'photo' FROM photos", "places photos")
def set_union_all(t: Tables) -> DataFrame:
    a = t.places.where("has_image").select(F.col("place_id").alias("id"), F.lit("place").alias("what"))
    return a.unionByName(t.photos.select(F.col("photo_id").alias("id"), F.lit("photo").alias("what")))


@query("SELECT place_id FROM reports UNION SELECT place_id FROM saved_places", "reports saved_places")
def set_union(t: Tables) -> DataFrame:
    return t.reports.select("place_id").union(t.saved_places.select("place_id")).distinct()


@query("SELECT route_id, coalesce(liked, saved) AS liked FROM routes LEFT JOIN route_feedback USING (route_id) WHERE saved OR liked IS NOT NULL", "routes route_feedback")
def set_votes_union_semantics(t: Tables) -> DataFrame:
    """Saved routes count as liked unless a vote says otherwise."""
    return t.routes.join(t.route_feedback, "route_id", "left").where("saved OR liked IS NOT NULL").select("route_id", F.coalesce("liked", "saved").alias("liked"))


@query(
    "SELECT place_id, min(list) AS list FROM (SELECT place_id, 1 AS list FROM places WHERE indoor UNION ALL SELECT place_id, 2 FROM places WHERE rating > 4 UNION ALL SELECT place_id, 3 FROM saved_places) x GROUP BY place_id",
    "places saved_places",
)
def set_merge_first_wins(t: Tables) -> DataFrame:
    lists = [t.places.where("indoor"), t.places.where("rating > 4"), t.saved_places]
    parts = [d.select("place_id", F.lit(i + 1).alias("list")) for i, d in enumerate(lists)]
    return first_per(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["place_id"], [F.col("list")])


@query("SELECT place_id, len(list_intersect(tags, ['small', 'gear'])) / len(list_distinct(list_concat(tags, ['small', 'gear']))) AS overlap FROM places", "places")
def set_jaccard(t: Tables) -> DataFrame:
    return t.places.select("place_id", jaccard(F.col("tags"), F.array(F.lit("small"), F.lit("gear"))).alias("overlap"))


@query("SELECT photo_id FROM photos f WHERE NOT EXISTS (SELECT 1 FROM reports r WHERE r.report_id = f.photo_id)", "photos reports")
def set_orphans(t: Tables) -> DataFrame:
    return t.photos.join(t.reports, F.col("photo_id") == F.col("report_id"), "left_anti").select("photo_id")


@query(
    "SELECT route_id, place_id, 'removed' AS change FROM route_stops a WHERE skipped AND NOT EXISTS (SELECT 1 FROM route_stops b WHERE b.route_id = a.route_id AND b.place_id = a.place_id AND NOT b.skipped)",
    "route_stops",
)
def set_route_diff(t: Tables) -> DataFrame:
    old, new = t.route_stops, t.route_stops.where("NOT skipped").select("route_id", "place_id")
    return old.where("skipped").join(new, ["route_id", "place_id"], "left_anti").select("route_id", "place_id", F.lit("removed").alias("change"))

@query(
    "SELECT route_id, day FROM routes r WHERE (status = 'ACTIVE' OR route_id IN (SELECT route_id FROM route_feedback WHERE liked)) AND EXISTS (SELECT 1 FROM route_stops s WHERE s.route_id = r.route_id)",
    "routes route_feedback route_stops",
)
def set_own_and_joined(t: Tables) -> DataFrame:
    """Routes that are active and those that were liked, each once, if they have stops."""
    own = t.routes.where("status = 'ACTIVE'")
    joined = t.routes.join(t.route_feedback.where("liked"), "route_id", "left_semi")
    return own.unionByName(joined).dropDuplicates(["route_id"]).join(t.route_stops, "route_id", "left_semi").select("route_id", "day")


@query("SELECT place_id, min(page) AS page FROM (SELECT place_id, 1 AS page FROM places WHERE indoor UNION ALL SELECT place_id, 2 FROM places WHERE rating >= 4) x GROUP BY place_id", "places")
def set_append_unique(t: Tables) -> DataFrame:
    """A second list put behind the first, without what the first one has."""
    a = t.places.where("indoor").select("place_id", F.lit(1).alias("page"))
    b = t.places.where("rating >= 4").select("place_id", F.lit(2).alias("page"))
    return a.unionByName(b.join(a, "place_id", "left_anti"))
