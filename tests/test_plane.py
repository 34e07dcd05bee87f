"""Unions, noding and holes against counting cells and points."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from cartolake.functions import geo
from cartolake.operators import plane
from cartolake.operators.rings import area


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def ell(x0, y0, x1, y1):
    mx, my = (x0 + x1) // 2, (y0 + y1) // 2
    return [(x0, y0), (x1, y0), (x1, my), (mx, my), (mx, y1), (x0, y1), (x0, y0)]


def inside(p, rings):
    x, y = p
    return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for r in rings for a, b in itertools.pairwise(r)) % 2 == 1


@pytest.mark.parametrize("seed", range(25))
def test_unions_of_boxes_and_ells(seed):
    r = random.Random(seed)
    shapes = []
    for _ in range(r.randint(1, 12)):
        x, y = r.randrange(0, 20, 2), r.randrange(0, 20, 2)
        shapes.append(r.choice([box, ell])(x, y, x + r.randrange(2, 12, 2), y + r.randrange(2, 12, 2)))
    cells = {(x, y) for x in range(40) for y in range(40) if any(inside((x + 0.5, y + 0.5), [s]) for s in shapes)}
    polygons = [[s] for s in shapes]
    assert plane.united_area(polygons) == pytest.approx(len(cells))
    rings = plane.united(polygons)
    assert all(inside((x + 0.5, y + 0.5), rings) == ((x, y) in cells) for x in range(40) for y in range(40))
    border = sum(((x + dx, y + dy) not in cells) for x, y in cells for dx, dy in ((0, 1), (1, 0), (0, -1), (-1, 0)))
    assert sum(math.dist(a, b) for ring in rings for a, b in itertools.pairwise(ring)) == pytest.approx(border)


@pytest.mark.parametrize("seed", range(15))
def test_unions_of_slanted_shapes(seed):
    """Random triangles and stars, by sampled points, and inclusion and exclusion of two."""
    r = random.Random(seed)

    def star():
        x, y, n = r.uniform(0, 10), r.uniform(0, 10), r.randint(3, 9)
        ring = [(x + r.uniform(1, 4) * math.cos(2 * math.pi * k / n), y + r.uniform(1, 4) * math.sin(2 * math.pi * k / n)) for k in range(n)]
        return [*ring, ring[0]]

    shapes = [star() for _ in range(r.randint(2, 6))]
    rings = plane.united([[s] for s in shapes])
    points = [(r.uniform(-4, 14), r.uniform(-4, 14)) for _ in range(1500)]
    wrong = [p for p in points if inside(p, rings) != any(inside(p, [s]) for s in shapes)]
    assert len(wrong) <= 1
    assert plane.united_area([[s] for s in shapes]) == pytest.approx(sum(area(x) * (1 if sum(inside(m, [o]) for o in rings if o is not x for m in [midpoint(x)]) % 2 == 0 else -1) for x in rings), rel=1e-6)


def midpoint(ring):
    (ax, ay), (bx, by) = ring[0], ring[1]
    return (ax + bx) / 2, (ay + by) / 2


def test_ways_that_cross_and_holes():
    hash_ = [[(-1, 0), (5, 0)], [(5, 4), (-1, 4)], [(0, -1), (0, 5)], [(4, 5), (4, -1)]]
    assert [[sorted(set(r)) for r in p] for p in plane.built(hash_)] == [[[(0, 0), (0, 4), (4, 0), (4, 4)]]]
    nested = [box(0, 0, 10, 10), box(2, 2, 8, 8), box(3, 3, 5, 5), box(20, 0, 22, 2)]
    ways = [[a, b] for ring in nested for a, b in itertools.pairwise(ring)] + [[(0, 0), (-3, 7)], [(2, 2), (1, 1), (1.5, 1.2)], [(10, 10), (8, 8)]]
    random.Random(1).shuffle(ways)
    found = plane.built(ways)
    assert sorted((len(p), round(area(p[0]) - sum(map(area, p[1:])), 6)) for p in found) == [(1, 4.0), (1, 4.0), (2, 64.0)]
    eight = [[(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]]
    assert sorted(area(p[0]) for p in plane.built(eight)) == [4.0, 4.0]
    assert plane.built([]) == [] and plane.built([[(0, 0)], [(0, 0), (1, 1)]]) == []


@pytest.mark.parametrize("seed", range(10))
def test_built_regions_by_even_odd_counting(seed):
    r = random.Random(seed)
    rings = [[(r.randint(0, 12), r.randint(0, 12)) for _ in range(r.randint(3, 5))] for _ in range(3)]
    rings = [[*x, x[0]] for x in rings]
    pieces = plane.noded([(s, 0) for s in plane.segments(rings)])
    if any(len(owners) > 1 for owners in pieces.values()):
        pytest.skip("edges that lie on each other count once")
    found = [x for p in plane.built(rings) for x in p]
    points = [(r.uniform(-1, 13), r.uniform(-1, 13)) for _ in range(800)]
    assert all(inside(p, found) == inside(p, rings) for p in points)


def test_columns_respect_holes(spark):
    """Inside, distance and a point inside of polygons with holes, against plain loops."""
    r = random.Random(3)
    rows = []
    for k in range(40):
        w = r.uniform(0.01, 0.03)
        hole = r.uniform(0.1, 0.45)
        outer = box(29.0, 41.0, 29.0 + w, 41.0 + w)
        inner = box(29.0 + w * (0.5 - hole), 41.0 + w * (0.5 - hole), 29.0 + w * (0.5 + hole), 41.0 + w * (0.5 + hole))
        rows.append((k, r.uniform(40.995, 41.035), r.uniform(28.995, 29.035), [outer, inner]))
    df = spark.createDataFrame(rows, "id int, lat double, lon double, rings array<array<struct<lon:double,lat:double>>>")
    lat, lon, rings = F.col("lat"), F.col("lon"), F.col("rings")
    found = df.select("*", geo.in_polygon(lat, lon, rings).alias("inside"), geo.polygon_distance(lat, lon, rings).alias("d"), geo.point_on_surface(rings).alias("p"))
    for row in found.collect():
        plain = [[(p.lon, p.lat) for p in ring] for ring in row.rings]
        assert row.inside == inside((row.lon, row.lat), plain)
        assert inside((row.p.lon, row.p.lat), plain)
        steps = [(a[0] + t / 400 * (b[0] - a[0]), a[1] + t / 400 * (b[1] - a[1])) for ring in plain for a, b in itertools.pairwise(ring) for t in range(401)]
        near = min(math.hypot((x - row.lon) * geo.LON_M, (y - row.lat) * geo.LAT_M) for x, y in steps)
        assert row.d == 0 if row.inside else near - 8 < row.d <= near + 1e-6
