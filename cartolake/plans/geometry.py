"""Outlines: rings stitched from ways, unions of parcels, distances and label points (inventory 2.6 and 2.10)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.functions.geo import LAT_M, LON_M, inside_point, point_on_surface, polygon_distance, ring_distance
from cartolake.operators import plane
from cartolake.operators.rings import area, stitched
from cartolake.operators.relational import expanded, shuffle_tasks
from cartolake.plans.registry import query
from cartolake.sources.tables import Tables

MID_LAT, MID_LON = "(south + north) / 2", "(west + east) / 2"


def rings(t: Tables) -> DataFrame:
    """district_id, the box's sides and ring: an L, the box without its north-east quarter."""
    at = lambda lat, lon: F.struct(F.expr(lon).alias("lon"), F.expr(lat).alias("lat"))
    corners = [("south", "west"), ("south", "east"), (MID_LAT, "east"), (MID_LAT, MID_LON), ("north", MID_LON), ("north", "west"), ("south", "west")]
    return t.districts.select("district_id", "city_id", "south", "north", "west", "east", F.array(*[at(*c) for c in corners]).alias("ring"))


def to_box(south: str, north: str, west: str, east: str) -> str:
    return f"sqrt(pow(greatest({south} - lat, 0, lat - {north}) * {LAT_M}, 2) + pow(greatest({west} - lon, 0, lon - {east}) * {LON_M}, 2))"


@query(f"SELECT place_id, district_id, round(least({to_box('south', MID_LAT, 'west', 'east')}, {to_box('south', 'north', 'west', MID_LON)}), 2) AS metres FROM places JOIN districts ON district_id = place_id % (SELECT count(*) FROM districts)", "places districts")
def geo_polygon_distance(t: Tables) -> DataFrame:
    """Planar distance of each place to an L-shaped outline, 0 inside."""
    n = F.broadcast(t.districts.agg(F.count("*").alias("n")))
    asked = t.places.select("place_id", "lat", "lon").crossJoin(n).withColumn("district_id", F.col("place_id") % F.col("n"))
    return asked.join(rings(t), "district_id").select("place_id", "district_id", F.round(ring_distance(F.col("lat"), F.col("lon"), F.col("ring")), 2).alias("metres"))


@query(f"SELECT district_id, round((south + {MID_LAT}) / 2, 9) AS lat, round({MID_LON}, 9) AS lon FROM districts", "districts")
def geo_point_on_surface(t: Tables) -> DataFrame:
    """A point inside each outline, in the middle of its widest stretch."""
    return rings(t).withColumn("p", inside_point(F.col("ring"))).select("district_id", F.round("p.lat", 9).alias("lat"), F.round("p.lon", 9).alias("lon"))


@query(f"SELECT district_id, 1 AS rings, 7 AS points, round((north - south) * (east - west) * 0.75e0 * 1e6, 6) AS area FROM districts", "districts")
def agg_build_polygon(t: Tables) -> DataFrame:
    """Outlines built from their ways, which come in any order and direction; a stray way that closes nothing is left out."""
    r = rings(t)
    edge = lambda i: F.struct(F.get("ring", i).alias("a"), F.get("ring", i + 1).alias("b"))
    ways = r.select("district_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("ring") - 2), edge)).alias("w"))
    turned = F.pmod(F.xxhash64("w"), F.lit(2)) == 0
    way = ways.select("district_id", F.when(turned, F.array("w.b", "w.a")).otherwise(F.array("w.a", "w.b")).alias("way"))
    stray = r.select("district_id", F.array(F.get("ring", F.lit(0)), F.struct((F.col("west") - 1).alias("lon"), F.col("south").alias("lat"))).alias("way"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        found = stitched([[(p["lon"], p["lat"]) for p in way] for way in group["way"]])
        return pd.DataFrame({"district_id": [group["district_id"].iat[0]], "rings": [len(found)], "points": [sum(map(len, found))], "area": [round(sum(map(area, found)) * 1e6, 6)]})

    # A relation's ways are one outline: thousands of points at most.
    return way.union(stray).groupBy("district_id").applyInPandas(build, "district_id long, rings int, points int, area double")


BOX = "DISTINCT city_id, CAST(round(south * 100) AS BIGINT) AS y, CAST(round(west * 50) AS BIGINT) AS x"


@query(
    f""", b AS (SELECT {BOX} FROM districts), e AS (SELECT city_id, unnest([[0, y, x], [0, y + 1, x], [1, y, x], [1, y, x + 1]]) AS e FROM b), o AS (SELECT city_id, e FROM e GROUP BY city_id, e HAVING count(*) = 1)
    SELECT city_id, (SELECT count(*) FROM b WHERE b.city_id = o.city_id) AS parts, count(*) AS edges, min(e[2]) AS south, max(e[2]) AS north, min(e[3]) AS west, max(e[3]) AS east FROM o GROUP BY city_id""",
    "districts",
)
def agg_geom_union(t: Tables) -> DataFrame:
    """Union of each city's parcels, which share whole edges: an edge of one parcel only is outline, one of two lies inside.

    Repeated parcels count once. Edges are counted by join-free aggregation, so a city of any size is spread over tasks.
    """
    b = t.districts.select("city_id", F.round(F.col("south") * 100).cast("long").alias("y"), F.round(F.col("west") * 50).cast("long").alias("x")).distinct()
    edge = lambda flat, y, x: F.struct(F.lit(flat).alias("flat"), y.alias("y"), x.alias("x"))
    y, x = F.col("y"), F.col("x")
    edges = b.select("city_id", F.explode(F.array(edge(0, y, x), edge(0, y + 1, x), edge(1, y, x), edge(1, y, x + 1))).alias("e"))
    outline = edges.groupBy("city_id", "e").agg(F.count("*").alias("n")).where("n = 1")
    found = outline.groupBy("city_id").agg(F.count("*").alias("edges"), F.min("e.y").alias("south"), F.max("e.y").alias("north"), F.min("e.x").alias("west"), F.max("e.x").alias("east"))
    return found.join(b.groupBy("city_id").agg(F.count("*").alias("parts")), "city_id")


#: Lots that overlap: each district's box with a margin, without its north-east quarter.
LOT_SIDES = "south - 0.003e0 AS s, north + 0.003e0 AS n, west - 0.005e0 AS w, east + 0.005e0 AS e"
#: Degrees of longitude that one task sweeps.
STRIP = 0.037


@query(
    f""", l AS (SELECT city_id, {LOT_SIDES} FROM districts), b AS (SELECT city_id, s, (s + n) / 2 AS n, w, e FROM l UNION ALL SELECT city_id, (s + n) / 2, n, w, (w + e) / 2 FROM l),
    y AS (SELECT city_id, y AS y0, lead(y) OVER (PARTITION BY city_id ORDER BY y) AS y1 FROM (SELECT city_id, s AS y FROM b UNION SELECT city_id, n FROM b) v), x AS (SELECT city_id, x AS x0, lead(x) OVER (PARTITION BY city_id ORDER BY x) AS x1 FROM (SELECT city_id, w AS x FROM b UNION SELECT city_id, e FROM b) v)
    SELECT y.city_id, (SELECT count(*) FROM l WHERE l.city_id = y.city_id) AS parts, round(sum((y1 - y0) * (x1 - x0)) * 1e6, 2) AS area FROM y JOIN x USING (city_id)
    WHERE EXISTS (SELECT 1 FROM b WHERE b.city_id = y.city_id AND s <= y0 AND n >= y1 AND w <= x0 AND e >= x1) GROUP BY y.city_id""",
    "districts",
)
def agg_geom_union_overlap(t: Tables) -> DataFrame:
    """Area of the union of each city's lots, which overlap as they like, by a sweep over strips of the plane.

    A lot goes to every strip that it touches, and a strip's part of the union is swept there, so a large city is many tasks' work.
    """
    lots = t.districts.selectExpr("city_id", *LOT_SIDES.split(", "))
    middle_y, middle_x = (F.col("s") + F.col("n")) / 2, (F.col("w") + F.col("e")) / 2
    corners = [("s", "w"), ("s", "e"), (middle_y, "e"), (middle_y, middle_x), ("n", middle_x), ("n", "w"), ("s", "w")]
    column = lambda c: F.col(c) if isinstance(c, str) else c
    ring = F.array(*[F.array(column(x), column(y)) for y, x in corners])
    # A lot that repeats another adds nothing to the union.
    dealt = lots.distinct().select("city_id", ring.alias("ring"), F.explode(F.sequence(F.floor(F.col("w") / STRIP), F.floor(F.col("e") / STRIP))).alias("strip"))

    def sweep(group: pd.DataFrame) -> pd.DataFrame:
        strip = int(group["strip"].iat[0])
        polygons = [[[tuple(p) for p in ring]] for ring in group["ring"]]
        return pd.DataFrame({"city_id": group["city_id"].iloc[:1], "area": [plane.united_area(polygons, (strip * STRIP, (strip + 1) * STRIP))]})

    areas = dealt.groupBy("city_id", "strip").applyInPandas(sweep, "city_id long, area double").groupBy("city_id").agg(F.round(F.sum("area") * 1e6, 2).alias("area"))
    return areas.join(lots.groupBy("city_id").agg(F.count("*").alias("parts")), "city_id").select("city_id", "parts", "area")


Q1_LAT, Q3_LAT, Q1_LON, Q3_LON = "(south * 0.75e0 + north * 0.25e0)", "(south * 0.25e0 + north * 0.75e0)", "(west * 0.75e0 + east * 0.25e0)", "(west * 0.25e0 + east * 0.75e0)"


def with_holes(t: Tables) -> DataFrame:
    """district_id, rings: the box and a hole of half its height and width in its middle."""
    at = lambda lat, lon: F.struct(F.expr(lon).alias("lon"), F.expr(lat).alias("lat"))
    ring = lambda s, n, w, e: F.array(at(s, w), at(s, e), at(n, e), at(n, w), at(s, w))
    return t.districts.select("district_id", F.array(ring("south", "north", "west", "east"), ring(Q1_LAT, Q3_LAT, Q1_LON, Q3_LON)).alias("rings"))


@query("SELECT district_id, 1 AS shells, 1 AS holes, round((north - south) * (east - west) * 0.75e0 * 1e6, 2) AS area FROM districts", "districts")
def agg_build_polygon_holes(t: Tables) -> DataFrame:
    """Polygons with holes built from ways that cross: the box's sides overshoot its corners, and a stray way ends in its middle."""
    from cartolake.operators.rings import area as size

    d = t.districts
    way = lambda *points: F.array(*[F.array(F.expr(lon), F.expr(lat)) for lat, lon in points])
    far = {"s": "(south * 1.1e0 - north * 0.1e0)", "n": "(north * 1.1e0 - south * 0.1e0)", "w": "(west * 1.1e0 - east * 0.1e0)", "e": "(east * 1.1e0 - west * 0.1e0)"}
    ways = F.array(
        way(("south", far["w"]), ("south", far["e"])), way(("north", far["e"]), ("north", far["w"])), way((far["n"], "west"), (far["s"], "west")), way((far["s"], "east"), (far["n"], "east")),
        way((Q1_LAT, Q1_LON), (Q1_LAT, Q3_LON), (Q3_LAT, Q3_LON)), way((Q1_LAT, Q1_LON), (Q3_LAT, Q1_LON), (Q3_LAT, Q3_LON)), way(("south", "west"), (Q1_LAT, Q1_LON)),
    )
    each = d.select("district_id", F.explode(ways).alias("way"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        found = plane.built([[tuple(p) for p in way] for way in group["way"]])
        inside = sum(size(p[0]) - sum(map(size, p[1:])) for p in found)
        return pd.DataFrame({"district_id": group["district_id"].iloc[:1], "shells": [len(found)], "holes": [sum(len(p) - 1 for p in found)], "area": [round(inside * 1e6, 2)]})

    # A relation's ways are one outline: thousands of points at most.
    return each.groupBy("district_id").applyInPandas(build, "district_id long, shells int, holes int, area double")


IN_HOLE = f"lat > {Q1_LAT} AND lat < {Q3_LAT} AND lon > {Q1_LON} AND lon < {Q3_LON}"


@query(
    f"SELECT place_id, district_id, round(CASE WHEN {IN_HOLE} THEN least((lat - {Q1_LAT}) * {LAT_M}, ({Q3_LAT} - lat) * {LAT_M}, (lon - {Q1_LON}) * {LON_M}, ({Q3_LON} - lon) * {LON_M}) ELSE {to_box('south', 'north', 'west', 'east')} END, 2) AS metres FROM places JOIN districts ON district_id % 10 = place_id % 10 AND (district_id // 10) % 5 = place_id % 5",
    "places districts",
)
def geo_polygon_distance_holes(t: Tables) -> DataFrame:
    """Planar distance of places to polygons with holes: 0 on the ground, and in a hole what is left to its rim."""
    asked = t.places.select("place_id", "lat", "lon", (F.col("place_id") % 10).alias("k"), (F.col("place_id") % 5).alias("m"))
    all_ = with_holes(t).withColumn("k", F.col("district_id") % 10).withColumn("m", F.floor(F.col("district_id") / 10) % 5)
    # Equal points and equal polygons are measured once.
    points, shapes = ["lat", "lon", "k", "m"], ["rings", "k2", "m2"]
    shaped = all_.withColumnsRenamed({"k": "k2", "m": "m2"})
    met = asked.select(*points).distinct().join(shaped.select(*shapes).distinct(), (F.col("k") == F.col("k2")) & (F.col("m") == F.col("m2")))
    measured = met.repartition(shuffle_tasks(met), *points, *shapes).withColumn("metres", F.round(polygon_distance(F.col("lat"), F.col("lon"), F.col("rings")), 2))
    return expanded(measured, asked, points, "place_id", shaped, shapes, "district_id").select("place_id", "district_id", "metres")


@query(f"SELECT district_id, round((south + {Q1_LAT}) / 2, 9) AS lat, round({MID_LON}, 9) AS lon FROM districts", "districts")
def geo_point_on_surface_holes(t: Tables) -> DataFrame:
    """A point on the ground of each polygon with a hole, which lies around its middle."""
    return with_holes(t).withColumn("p", point_on_surface(F.col("rings"))).select("district_id", F.round("p.lat", 9).alias("lat"), F.round("p.lon", 9).alias("lon"))
