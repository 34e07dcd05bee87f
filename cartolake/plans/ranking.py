"""Sort, limit, top-k and scoring (inventory 2.8 and 2.12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.functions import scores as S
from cartolake.functions.geo import haversine, haversine_sql, near
from cartolake.operators import predicates as P
from cartolake.operators.relational import first_per, same_as, within
from cartolake.plans.filters import HERE, PLANNABLE
from cartolake.plans.registry import query
from cartolake.sources.tables import Tables

D = f"round({haversine_sql('lat', 'lon', '41.0e0', '29.1e0')}, 2)"


def around(df: DataFrame, metres: float = 5000) -> DataFrame:
    """Rows within a radius of the place asked about, with their distance."""
    here = haversine(F.col("lat"), F.col("lon"), F.lit(HERE[0]), F.lit(HERE[1]))
    return df.where(near(F.col("lat"), F.col("lon"), HERE, metres)).withColumn("metres", F.round(here, 2))


@query(f"SELECT place_id, {D} AS metres FROM places WHERE {D} <= 5000 AND NOT hidden AND NOT unconfirmed AND category NOT IN ('MARKET', 'WORSHIP') ORDER BY metres, place_id LIMIT 20", "places")
def topk_nearby(t: Tables) -> DataFrame:
    return around(t.places.where(P.listed())).select("place_id", "metres").orderBy("metres", "place_id").limit(20)


@query(f"SELECT place_id, {D} AS metres FROM places WHERE {D} <= 5000 AND {PLANNABLE} AND (category IN ('CAFE', 'RESTAURANT') OR list_contains(tags, 'widget')) ORDER BY metres, place_id LIMIT 40", "places")
def topk_candidates(t: Tables) -> DataFrame:
    return around(t.places.where(P.fills_stop(["CAFE", "RESTAURANT"], "widget"))).select("place_id", "metres").orderBy("metres", "place_id").limit(40)


@query(f"SELECT place_id, {D} AS metres FROM places WHERE {D} <= 8000 AND {PLANNABLE} AND category IN ('MUSEUM', 'PARK') AND list_has_any(tags, ['small', 'cold']) ORDER BY metres, place_id LIMIT 30", "places")
def topk_interest(t: Tables) -> DataFrame:
    wanted = P.fills_stop(["MUSEUM", "PARK"], None) & F.arrays_overlap("tags", F.array(F.lit("small"), F.lit("cold")))
    return around(t.places.where(wanted), 8000).select("place_id", "metres").orderBy("metres", "place_id").limit(30)


@query(f"SELECT place_id, {D} AS metres FROM places WHERE {D} <= 8000 AND {PLANNABLE} AND (lower(name) LIKE '%gear%' OR lower(name) LIKE '%cold%') ORDER BY metres, place_id LIMIT 30", "places")
def topk_wish(t: Tables) -> DataFrame:
    wanted = P.plannable() & F.exists(F.split(F.lit("%gear%,%cold%"), ","), lambda p: F.like(F.lower("name"), p))
    return around(t.places.where(wanted), 8000).select("place_id", "metres").orderBy("metres", "place_id").limit(30)


@query(f"SELECT place_id, rating, {D} AS metres FROM places WHERE {D} <= 6000 AND NOT {D} <= 2000 AND {PLANNABLE} ORDER BY rating DESC NULLS LAST, metres, place_id LIMIT 20", "places")
def topk_ring(t: Tables) -> DataFrame:
    ring = around(t.places.where(P.plannable()), 6000).where("NOT metres <= 2000")
    return ring.select("place_id", "rating", "metres").orderBy(F.desc_nulls_last("rating"), "metres", "place_id").limit(20)


@query(f"SELECT place_id FROM places WHERE NOT hidden AND lat BETWEEN 40.95e0 AND 41.05e0 AND lon BETWEEN 29.05e0 AND 29.15e0 ORDER BY CASE WHEN source = 'VERIFIED' THEN 0 ELSE 1 END, {D}, place_id LIMIT 25", "places")
def topk_in_area(t: Tables) -> DataFrame:
    box = ~F.col("hidden") & F.col("lat").between(40.95, 41.05) & F.col("lon").between(29.05, 29.15)
    d = F.round(haversine(F.col("lat"), F.col("lon"), F.lit(HERE[0]), F.lit(HERE[1])), 2)
    return t.places.where(box).orderBy(F.when(F.col("source") == "VERIFIED", 0).otherwise(1), d, "place_id").limit(25).select("place_id")


@query("SELECT place_id FROM places ORDER BY (place_id * 104729 + 7 * 7919) % 1000003, place_id LIMIT 20", "places")
def sample_random(t: Tables) -> DataFrame:
    """A seeded random sample of 20 places (the sample is the feature), drawn by arithmetic on the id, so that it can be drawn again."""
    return t.places.orderBy(F.expr("(place_id * 104729 + 7 * 7919) % 1000003"), "place_id").limit(20).select("place_id")


RATED = "SELECT p.place_id, p.city_id, p.rating, p.name, p.source, p.has_image, coalesce(sum(r.stars), 0) AS total, count(r.stars) AS n FROM places p LEFT JOIN place_ratings r USING (place_id) GROUP BY ALL"
SCORE = "round((coalesce(rating, 3.8e0) * 5 + total) / (5 + n), 6)"


def rated(t: Tables) -> DataFrame:
    r = t.place_ratings.groupBy("place_id").agg(F.sum("stars").alias("total"), F.count("*").alias("n"))
    p = t.places.join(r, "place_id", "left").withColumns({"total": F.coalesce("total", F.lit(0)), "n": F.coalesce("n", F.lit(0))})
    return p.withColumn("score", F.round(S.bayes(F.col("total"), F.col("n"), F.col("rating")), 6))


@query(f"SELECT place_id, {SCORE} AS score FROM ({RATED}) x", "places place_ratings")
def num_bayes(t: Tables) -> DataFrame:
    return rated(t).select("place_id", "score")


@query(f"SELECT place_id, n >= 5 AND total / n >= 4.3e0 AS favourite FROM ({RATED}) x WHERE n > 0", "places place_ratings")
def num_is_favorite(t: Tables) -> DataFrame:
    return rated(t).where("n > 0").select("place_id", S.is_favourite(F.col("total"), F.col("n")).alias("favourite"))


@query(f"SELECT place_id, {SCORE} AS score, n FROM ({RATED}) x WHERE n >= 3 ORDER BY score DESC, n DESC, place_id LIMIT 30", "places place_ratings")
def topk_favorites(t: Tables) -> DataFrame:
    return rated(t).where("n >= 3").select("place_id", "score", "n").orderBy(F.desc("score"), F.desc("n"), "place_id").limit(30)


@query(
    f"SELECT place_id FROM ({RATED}) x ORDER BY {SCORE} DESC, CASE WHEN source = 'VERIFIED' THEN 0 ELSE 1 END, CASE WHEN has_image THEN 0 ELSE 1 END, name, place_id LIMIT 40 OFFSET 20",
    "places place_ratings",
)
def sort_community_list(t: Tables) -> DataFrame:
    order = (F.desc("score"), F.when(F.col("source") == "VERIFIED", 0).otherwise(1), F.when(F.col("has_image"), 0).otherwise(1), F.col("name"), F.col("place_id"))
    return rated(t).orderBy(*order).offset(20).limit(40).select("place_id")


@query("SELECT place_id FROM places WHERE category IN ('MUSEUM', 'ATTRACTION', 'PARK') ORDER BY popularity DESC NULLS LAST, source = 'VERIFIED' DESC, rating DESC NULLS LAST, place_id LIMIT 250", "places")
def topk_seeds(t: Tables) -> DataFrame:
    seeds = t.places.where("category IN ('MUSEUM', 'ATTRACTION', 'PARK')")
    return seeds.orderBy(F.desc_nulls_last("popularity"), (F.col("source") == "VERIFIED").desc(), F.desc_nulls_last("rating"), "place_id").limit(250).select("place_id")


@query(
    f"""SELECT a.place_id, count(*) AS food FROM places a JOIN places b ON b.category IN ('CAFE', 'RESTAURANT') AND {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 1500
    WHERE a.category IN ('MUSEUM', 'ATTRACTION') GROUP BY a.place_id, a.popularity HAVING count(*) >= 2 ORDER BY a.popularity DESC, a.place_id LIMIT 1""",
    "places",
)
def topk_best_sight(t: Tables) -> DataFrame:
    sights = t.places.where("category IN ('MUSEUM', 'ATTRACTION')").select("place_id", "lat", "lon", "popularity")
    food = t.places.where("category IN ('CAFE', 'RESTAURANT')").select("place_id", "lat", "lon")
    # Food is counted by point, and points meet.
    counted = food.groupBy("lat", "lon").agg(F.count("*").alias("n"))
    near = within(sights.select("lat", "lon").distinct(), counted, 1500, "lat", "lat").groupBy("a.lat", "a.lon").agg(F.sum("b.n").alias("n"))
    near_food = same_as(sights, near, ["lat", "lon"]).groupBy("place_id", "popularity").agg(F.sum("n").alias("food"))
    return near_food.where("food >= 2").orderBy(F.desc("popularity"), "place_id").limit(1).select("place_id", "food")


@query("SELECT place_id, name, (SELECT count(*) FROM places WHERE NOT hidden) AS total FROM places WHERE NOT hidden ORDER BY name, place_id LIMIT 20 OFFSET 40", "places")
def page_offset(t: Tables) -> DataFrame:
    shown = t.places.where("NOT hidden")
    return shown.orderBy("name", "place_id").offset(40).limit(20).select("place_id", "name").crossJoin(shown.agg(F.count("*").alias("total")))


@query("SELECT name FROM cities ORDER BY name LIMIT 5", "cities")
def sort_collation_tr(t: Tables) -> DataFrame:
    return t.cities.orderBy(F.collate("name", "tr")).limit(5).select("name")


FIT = f"floor(({D} / -250.0e0 + coalesce(rating, 3.8e0) * 20) * 10 + 0.5e0) / 10"


def fit(df: DataFrame) -> DataFrame:
    return around(df, 9000).withColumn("fit", S.tenth(F.col("metres") / -250.0 + F.coalesce("rating", F.lit(3.8)) * 20))


@query(f"SELECT place_id, {FIT} AS fit FROM places WHERE {D} <= 9000 AND {PLANNABLE} ORDER BY fit DESC, place_id LIMIT 12", "places")
def topk_recommend(t: Tables) -> DataFrame:
    return fit(t.places.where(P.plannable())).select("place_id", "fit").orderBy(F.desc("fit"), "place_id").limit(12)


@query(
    f", f AS (SELECT place_id, {D} AS metres, {FIT} AS fit FROM places WHERE {D} <= 9000 AND {PLANNABLE}) SELECT place_id, fit FROM f WHERE metres > 2000 AND fit >= coalesce((SELECT max(fit) + 8 FROM f WHERE metres <= 2000 AND fit < 60), 70)",
    "places",
)
def topk_farther(t: Tables) -> DataFrame:
    f = fit(t.places.where(P.plannable()))
    bar = f.where("metres <= 2000 AND fit < 60").agg(F.coalesce(F.max("fit") + 8, F.lit(70.0)).alias("bar"))
    return f.where("metres > 2000").crossJoin(bar).where("fit >= bar").select("place_id", "fit")


@query(
    f"""SELECT slot, place_id FROM (SELECT category AS slot, place_id, row_number() OVER (PARTITION BY category ORDER BY rating DESC NULLS LAST, {D}, place_id) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY category ORDER BY {D}, place_id) AS k FROM places WHERE {PLANNABLE}) x WHERE k <= 3) y WHERE n = 1""",
    "places",
)
def greedy_sample_day(t: Tables) -> DataFrame:
    """For each slot the best rated of the three closest."""
    p = around(t.places.where(P.plannable()), 1e6)
    closest = first_per(p, ["category"], [F.col("metres"), F.col("place_id")], 3)
    return first_per(closest, ["category"], [F.desc_nulls_last("rating"), F.col("metres"), F.col("place_id")]).select(F.col("category").alias("slot"), "place_id")


SCORED = f"""SELECT place_id, round(20 * {SCORE} - 25 * metres / 2500.0e0 + CASE WHEN saved THEN 18 ELSE 0 END + CASE WHEN NOT indoor THEN -40 ELSE 10 END
 + CASE WHEN list_has_any(tags, ['small', 'cold']) THEN 30 ELSE 0 END + CASE WHEN cost IS NULL THEN -4 WHEN cost <= 500 THEN 10 * (1 - cost / 500.0e0) ELSE -20 END
 + CASE WHEN known THEN 0 ELSE -3 END, 4) AS score FROM f"""


@query(
    f""", r AS (SELECT place_id, sum(stars) AS total, count(*) AS n FROM place_ratings GROUP BY place_id), f AS (SELECT p.place_id, p.rating, p.indoor, p.tags, p.cost, {D} AS metres, coalesce(total, 0) AS total, coalesce(n, 0) AS n,
    p.place_id IN (SELECT place_id FROM saved_places WHERE user_id = 1) AS saved, p.place_id IN (SELECT place_id FROM opening_hours) AS known FROM places p LEFT JOIN r USING (place_id) WHERE {D} <= 2500 AND {PLANNABLE}) {SCORED}""",
    "places place_ratings saved_places opening_hours",
)
def pl_score(t: Tables) -> DataFrame:
    """Score of each candidate stop in wet weather, with an allowance of 500, from here."""
    saved = t.saved_places.where("user_id = 1").select("place_id", F.lit(True).alias("saved"))
    known = t.opening_hours.select("place_id").distinct().withColumn("known", F.lit(True))
    f = around(rated(t).where(P.plannable()), 2500).join(saved, "place_id", "left").join(known, "place_id", "left")
    budget = F.when(F.col("cost").isNull(), -4).when(F.col("cost") <= 500, 10 * (1 - F.col("cost") / 500.0)).otherwise(-20)
    score = (
        20 * F.col("score")
        - 25 * F.col("metres") / 2500.0
        + F.when(F.col("saved"), 18).otherwise(0)
        + F.when(~F.col("indoor"), -40).otherwise(10)
        + F.when(F.arrays_overlap("tags", F.array(F.lit("small"), F.lit("cold"))), 30).otherwise(0)
        + budget
        + F.when(F.col("known"), 0).otherwise(-3)
    )
    return f.select("place_id", F.round(score, 4).alias("score"))


@query("SELECT event_id, (kind = 'error' OR cost > 400) AS wet, cost > 350 AND hour(created_at) BETWEEN 11 AND 17 AS hot, cost < 50 AS cold FROM usage", "usage")
def pl_weather_flags(t: Tables) -> DataFrame:
    hour = F.hour("created_at")
    return t.usage.select("event_id", ((F.col("kind") == "error") | (F.col("cost") > 400)).alias("wet"), ((F.col("cost") > 350) & hour.between(11, 17)).alias("hot"), (F.col("cost") < 50).alias("cold"))


@query("SELECT place_id, CAST(ceil(least(greatest(540 + CAST(ceil(metres * 1.3e0 / 75.0e0) AS INT), 600 - 30), 540 + CAST(ceil(metres * 1.3e0 / 75.0e0) AS INT) + 20) / 5.0e0) * 5 AS INT) AS arrival FROM (SELECT place_id, " + D + " AS metres FROM places) x", "places")
def pl_timing(t: Tables) -> DataFrame:
    """Arrival: after the walk, not before the target less its flexibility, waiting 20 minutes at most, on five minutes."""
    from cartolake.functions.geo import walk_minutes

    there = F.lit(540) + walk_minutes(F.col("metres"))
    return around(t.places, 1e6).select("place_id", S.round5(F.least(F.greatest(there, F.lit(570)), there + 20)).alias("arrival"))


@query(
    "SELECT r.route_id, count(*) FILTER (NOT s.skipped) >= ceil(count(*) * 0.6e0) AND coalesce(sum(p.cost) FILTER (NOT s.skipped), 0) <= any_value(r.budget) AS accepted FROM routes r JOIN route_stops s USING (route_id) JOIN places p USING (place_id) GROUP BY r.route_id",
    "routes route_stops places",
)
def pl_template_accept(t: Tables) -> DataFrame:
    rows = t.routes.select("route_id", "budget").join(t.route_stops, "route_id").join(t.places.select("place_id", "cost"), "place_id")
    kept = F.count_if(~F.col("skipped"))
    cost = F.coalesce(F.sum(F.when(~F.col("skipped"), F.col("cost"))), F.lit(0))
    return rows.groupBy("route_id").agg(((kept >= F.ceil(F.count("*") * F.lit(0.6))) & (cost <= F.first("budget"))).alias("accepted"))


#: A day's slots: when they start at the earliest, how long they take, and the segments of users who want them beside the usual ones.
DAY = "('BREAKFAST', 540, 45, NULL), ('SIGHT', 660, 90, NULL), ('LUNCH', 780, 60, NULL), ('SIGHT', 900, 90, NULL), ('COFFEE', 960, 30, 'HOUSEHOLD'), ('SIGHT', 1020, 60, 'BUILDING'), ('DINNER', 1170, 90, NULL)"


@query(
    f""", d(slot, starts, minutes, segment) AS (VALUES {DAY}), u AS (SELECT user_id, segment, 480 + user_id % 6 * 60 AS opens, 1140 + user_id % 4 * 60 AS closes FROM users)
    SELECT user_id, slot, starts, row_number() OVER (PARTITION BY user_id ORDER BY starts) AS position FROM u JOIN d ON starts >= opens AND starts + minutes <= closes AND (d.segment IS NULL OR d.segment = u.segment)""",
    "users",
)
def pl_day_template(t: Tables) -> DataFrame:
    """The slots of each user's day: those that fit between its start and its end, with what the user's segment adds."""
    from pyspark.sql.window import Window

    day = t.spark.sql(f"SELECT slot, starts, minutes, segment AS only FROM VALUES {DAY} AS d(slot, starts, minutes, segment)")
    slots = F.broadcast(day.agg(F.collect_list(F.struct("slot", "starts", "minutes", "only")).alias("day")))  # one row
    u = t.users.select("user_id", "segment", (480 + F.col("user_id") % 6 * 60).alias("opens"), (1140 + F.col("user_id") % 4 * 60).alias("closes")).crossJoin(slots)
    fits = F.filter("day", lambda d: (d["starts"] >= F.col("opens")) & (d["starts"] + d["minutes"] <= F.col("closes")) & F.coalesce(d["only"] == F.col("segment"), F.lit(True)))
    each = u.select("user_id", F.posexplode(F.array_sort(F.transform(fits, lambda d: F.struct(d["starts"].alias("starts"), d["slot"].alias("slot"))))).alias("n", "d"))
    return each.select("user_id", "d.slot", "d.starts", (F.col("n") + 1).cast("long").alias("position"))


@query("SELECT city_id, row_number() OVER (ORDER BY (city_id = 7) DESC, region_id DESC NULLS LAST, name) AS rank FROM cities", "cities")
def sort_import_plan(t: Tables) -> DataFrame:
    """One city first, then by region and name: ranked within its group, plus the number of rows in the groups before it."""
    from pyspark.sql.window import Window

    group = ["later", "region_id"]
    c = t.cities.withColumn("later", F.col("city_id") != 7)
    order = [F.col("later"), F.col("region_id").desc_nulls_last()]
    # One row for each region is all that this window orders as a whole.
    sizes = c.groupBy(*group).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumnsRenamed({"later": "l", "region_id": "r"})
    joined = c.join(sizes, (F.col("later") == F.col("l")) & F.col("region_id").eqNullSafe(F.col("r")))
    return joined.select("city_id", (F.col("before") + F.row_number().over(Window.partitionBy(*group).orderBy("name"))).alias("rank"))
