"""Geographic columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
DETOUR, METRES_PER_MINUTE = 1.3, 75.0
CELL_LAT, CELL_LON = 0.0015, 0.002


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Metres between two points on a sphere, the root held to 1; null where a coordinate is."""
    lat1, lon1, lat2, lon2 = (x if isinstance(x, Column) else F.lit(x) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.when(a > 1, F.lit(1.0)).otherwise(F.sqrt(a)))  # least() would skip a null


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The same in SQL, by the chord between the points, so that twins do not share the formula's faults."""
    x = lambda lat, lon: f"cos(radians({lat})) * cos(radians({lon}))"
    y = lambda lat, lon: f"cos(radians({lat})) * sin(radians({lon}))"
    squared = f"pow({x(lat1, lon1)} - {x(lat2, lon2)}, 2) + pow({y(lat1, lon1)} - {y(lat2, lon2)}, 2) + pow(sin(radians({lat1})) - sin(radians({lat2})), 2)"
    return f"(CASE WHEN {lat1} IS NOT NULL AND {lon1} IS NOT NULL AND {lat2} IS NOT NULL AND {lon2} IS NOT NULL THEN 12742000.0e0 * asin(least(1.0e0, sqrt({squared}) / 2)) END)"


def lon_reach(metres: float, lat: Column) -> Column:
    """Degrees of longitude that `metres` reach at a latitude, 360 where they reach around a pole; a little more, for rounding."""
    share = math.sin(min(metres / (2 * EARTH_M), math.pi / 2)) / F.cos(F.radians(F.abs(lat)))
    return F.when((F.abs(lat) >= 90) | (share >= 1), F.lit(360.0)).otherwise(F.degrees(2 * F.asin(share)) * 1.001)


def near(lat: Column, lon: Column, at: tuple[float, float], metres: float) -> Column:
    """Inclusive radius, with a bounding box in front that reaches the scan's statistics; right at poles and the antimeridian too."""
    d_lat = math.degrees(metres / EARTH_M) * 1.001
    edge = abs(at[0]) + d_lat
    share = math.sin(min(metres / (2 * EARTH_M), math.pi / 2)) / math.cos(math.radians(edge)) if edge < 90 else 1.0
    box = lat.between(at[0] - d_lat, at[0] + d_lat)
    if share < 1:
        d_lon = math.degrees(2 * math.asin(share)) * 1.001
        west, east = at[1] - d_lon, at[1] + d_lon
        around = lon.between(west, east)
        if west < -180:
            around = around | (lon >= west + 360)
        if east > 180:
            around = around | (lon <= east - 360)
        box = box & around
    return box & (haversine(lat, lon, F.lit(at[0]), F.lit(at[1])) <= metres)


def walk_minutes(metres: Column) -> Column:
    return F.ceil(metres * DETOUR / METRES_PER_MINUTE).cast("int")


def cell(lat: Column, lon: Column, d_lat: float = CELL_LAT, d_lon: float = CELL_LON) -> Column:
    """Grid cell as (y, x)."""
    return F.struct(F.floor(lat / d_lat).alias("y"), F.floor(lon / d_lon).alias("x"))


def neighbour_cells(c: Column) -> Column:
    """The cell and the eight around it."""
    return F.array(*[F.struct((c["y"] + i).alias("y"), (c["x"] + j).alias("x")) for i in (-1, 0, 1) for j in (-1, 0, 1)])


def edges_of(ring: Column) -> Column:
    """The edges (a, b) of a closed ring (array of structs lon, lat)."""
    return F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))


def edges_of_all(rings: Column) -> Column:
    """The edges of all rings of a polygon, shells and holes alike."""
    return F.flatten(F.transform(rings, edges_of))


def _odd(lat: Column, lon: Column, edges: Column) -> Column:
    """Whether a point has an odd number of edges to its east."""

    def crosses(e: Column) -> Column:
        straddles = (e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)
        at = e["a"]["lon"] + (lat - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) * (e["b"]["lon"] - e["a"]["lon"])
        return straddles & (lon < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a point lies in a closed ring."""
    return _odd(lat, lon, edges_of(ring))


def in_polygon(lat: Column, lon: Column, rings: Column) -> Column:
    """Whether a point lies in a polygon and in none of its holes (array of rings, in any order)."""
    return _odd(lat, lon, edges_of_all(rings))


def box_cells(south: Column, north: Column, west: Column, east: Column, size: float) -> Column:
    """The grid cells that a box touches; cells should be about as large as boxes are."""
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(span(south, north), lambda y: F.transform(span(west, east), lambda x: F.struct(y.alias("y"), x.alias("x")))))


LAT_M, LON_M = 111_195.0, 83_900.0


def _to_edge(lat: Column, lon: Column, e: Column) -> Column:
    ax, ay = (e["a"]["lon"] - lon) * LON_M, (e["a"]["lat"] - lat) * LAT_M
    dx, dy = (e["b"]["lon"] - e["a"]["lon"]) * LON_M, (e["b"]["lat"] - e["a"]["lat"]) * LAT_M
    length = dx * dx + dy * dy
    at = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length)))
    return F.sqrt(F.pow(ax + at * dx, 2) + F.pow(ay + at * dy, 2))


def _distance(lat: Column, lon: Column, edges: Column) -> Column:
    return F.when(_odd(lat, lon, edges), F.lit(0.0)).otherwise(F.array_min(F.transform(edges, lambda e: _to_edge(lat, lon, e))))


def ring_distance(lat: Column, lon: Column, ring: Column) -> Column:
    """Planar metres (at 41 degrees) from a point to a closed ring, 0 inside: the least distance to one of its edges."""
    return _distance(lat, lon, edges_of(ring))


def polygon_distance(lat: Column, lon: Column, rings: Column) -> Column:
    """The same to a polygon with holes: in a hole the distance to what is around it."""
    return _distance(lat, lon, edges_of_all(rings))


def _inside_point(edges: Column) -> Column:
    """The middle of the widest stretch inside on the lines midway between neighbouring latitudes of corners; of equally wide
    ones the southernmost, then westernmost."""
    lats = F.array_sort(F.array_distinct(F.transform(edges, lambda e: e["a"]["lat"])))
    lines = F.transform(F.sequence(F.lit(0), F.size(lats) - 2), lambda i: (F.get(lats, i) + F.get(lats, i + 1)) / 2)

    def stretches(y: Column) -> Column:
        met = F.filter(edges, lambda e: (e["a"]["lat"] > y) != (e["b"]["lat"] > y))
        xs = F.array_sort(F.transform(met, lambda e: e["a"]["lon"] + (y - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) * (e["b"]["lon"] - e["a"]["lon"])))
        pairs = F.sequence(F.lit(0), F.floor(F.size(xs) / 2).cast("int") - 1)
        return F.transform(pairs, lambda i: F.struct((F.get(xs, 2 * i) - F.get(xs, 2 * i + 1)).alias("less"), y.alias("lat"), ((F.get(xs, 2 * i) + F.get(xs, 2 * i + 1)) / 2).alias("lon")))

    widest = F.array_min(F.flatten(F.transform(lines, stretches)))
    return F.struct(widest["lat"].alias("lat"), widest["lon"].alias("lon"))


def inside_point(ring: Column) -> Column:
    """A point (lat, lon) inside a closed ring."""
    return _inside_point(edges_of(ring))


def point_on_surface(rings: Column) -> Column:
    """A point (lat, lon) inside a polygon and in none of its holes."""
    return _inside_point(edges_of_all(rings))
