"""Greedy selections, opening hours and day plans against plain versions."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from cartolake.functions import geo
from cartolake.functions.hours import week
from cartolake.functions.sides import MIDLINE
from cartolake.operators import greedy
from cartolake.operators.rings import area, stitched
from cartolake.plans import catalog
from cartolake.sources.tables import Tables

SF = "/root/testdata/sf0.001"
#: The smallest tables with groups of sights.
GROUPS_SF = "/root/testdata/sf0.01"


def test_first_come(spark):
    r = random.Random(1)
    edges = {tuple(sorted((r.randint(0, 80), r.randint(0, 80)))) for _ in range(120)} | {(i, i + 1) for i in range(100, 130)}
    edges = [(a, b) for a, b in edges if a != b]
    kept = []
    for i in range(140):
        if not any((k, i) in set(edges) for k in kept):
            kept.append(i)
    ids = spark.range(140)
    found = greedy.first_come(ids, spark.createDataFrame(edges, "before long, after long"))
    assert sorted(x.id for x in found.collect()) == kept


def test_first_come_contracts_chains(spark, monkeypatch):
    """A chain of 1,000 and combs of chains: few rounds, the same result as a pass."""
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(1000)] + [(2000 + i, 2000 + i + k) for i in range(0, 600, 2) for k in (1, 2)] + [(r.randint(0, 999), 3000 + k) for k in range(50)] + [(3000 + k, 3000 + k + 1) for k in range(49)]
    before = {}
    for a, b in edges:
        before.setdefault(b, set()).add(a)
    kept = {}
    for i in range(3100):
        kept[i] = not any(kept[a] for a in before.get(i, ()))
    rounds = []
    monkeypatch.setattr(greedy, "shared_path", lambda *a, f=greedy.shared_path: rounds.append(1) or f(*a))
    found = greedy.first_come(spark.range(3100), spark.createDataFrame(edges, "before long, after long"))
    assert {x.id for x in found.collect()} == {i for i, k in kept.items() if k}
    assert len(rounds) / 3 <= 20


def test_dedupe_self(spark):
    t = Tables(spark, SF)
    rows = sorted(((p.place_id, p.category, p.name, (p.lat, p.lon)) for p in t.places.collect()))
    kept = []
    for i, c, n, at in rows:
        if not any(c == kc and n == kn and greedy.metres(at, kat) <= 2000 for _, kc, kn, kat in kept):
            kept.append((i, c, n, at))
    found = catalog.queries()["er_dedupe_self"](spark, SF).collect()
    assert sorted(x.place_id for x in found) == [k[0] for k in kept]


def side(lat, lon):
    """Whether a point of the province is east of the strait's middle, drawn as straight lines."""
    line = sorted(MIDLINE)
    if lat <= line[0][0] or lat >= line[-1][0]:
        return lon > (line[0] if lat <= line[0][0] else line[-1])[1]
    (y0, x0), (y1, x1) = next((a, b) for a, b in itertools.pairwise(line) if a[0] <= lat <= b[0])
    return lon > x0 + (x1 - x0) * (lat - y0) / (y1 - y0)


def test_clusters(spark):
    from cartolake.plans.resolution import sights

    s = sorted(sights(Tables(spark, GROUPS_SF)).collect(), key=lambda p: (-p.score, p.place_id))
    taken, groups = set(), {}
    for c in s:
        if c.place_id in taken:
            continue
        members = [m for m in s if m.place_id not in taken and greedy.metres((c.lat, c.lon), (m.lat, m.lon)) <= 900 and side(c.lat, c.lon) == side(m.lat, m.lon)]
        taken |= {m.place_id for m in members}
        if len(members) >= 3:
            groups[c.place_id] = round(sum(sorted((m.score for m in members), reverse=True)[:5]), 4)
    found = {r.centre: r.score for r in catalog.queries()["pl_clusters"](spark, GROUPS_SF).collect()}
    assert found == groups and len(groups) > 5


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("24/7", [(d, 0, 0) for d in range(1, 8)]),
        ("Tu-Th 07:15-11:45", [(2, 435, 705), (3, 435, 705), (4, 435, 705)]),
        ("th,sa 06:00-09:30,17:00-22:10", [(4, 360, 570), (4, 1020, 1330), (6, 360, 570), (6, 1020, 1330)]),
        ("Fr-Tu 11:20-23:40; Mo closed;", [(2, 680, 1420), (5, 680, 1420), (6, 680, 1420), (7, 680, 1420)]),
        ("We 21:00-04:30", [(3, 1260, 270)]),
        ("00:00-24:00; Th 00:00-24:00", [(d, 0, 0) for d in range(1, 8)]),
        ("We 08:00-12:00; We 13:00-14:00", [(3, 780, 840)]),
        ("Fr 06:00-06:00", []),
        ("Su 09:61-10:00", []),
        ("Tu 08:00-24:01", []),
        ("Tu 24:00-24:00", []),
        ("Xy 08:00-09:00", []),
        ("Sa 08:00", []),
        ("Sa 08:00-09:00 and more", []),
        ("off", []),
        ("  ", []),
        (None, []),
    ],
)
def test_hours(text, rows):
    assert week(text) == rows


def test_hours_written_and_read():
    """Weeks made at random come back, days and spans in any order of rules."""
    r = random.Random(7)
    names = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")
    clock = lambda m: f"{m // 60:02d}:{m % 60:02d}"
    for _ in range(300):
        days = {}
        for d in r.sample(range(7), r.randint(1, 7)):
            a, b, c = sorted(r.sample(range(1, 1440), 3))
            days[d] = r.choice([[(a, b)], [(a, b), (c, a)]])
        rules = [f"{names[d]} {','.join(f'{clock(x)}-{clock(y)}' for x, y in spans)}" for d, spans in days.items()]
        assert week("; ".join(rules)) == [(d + 1, x, y) for d in sorted(days) for x, y in days[d]]


def test_match_confirm_add(spark):
    """Row by row: the nearest known place of a like name is confirmed, else the row is added unless it copies one added before."""
    fold = lambda n: "".join(c for c in n.lower() if c.isalnum())

    def alike(a, b):
        a, b = sorted((fold(a), fold(b)), key=len)
        return a == b or (len(a) >= 4 and a in b)

    p = sorted(Tables(spark, SF).places.collect(), key=lambda x: x.place_id)
    old, wanted, added = [x for x in p if x.source == "OSM"], [], []
    at = lambda x: (x.lat, x.lon)
    for x in p:
        if x.source != "OVERTURE":
            continue
        near = [(round(greedy.metres(at(x), at(o)), 3), o.place_id) for o in old if greedy.metres(at(x), at(o)) <= 600 and alike(x.name, o.name)]
        if near:
            wanted.append((x.place_id, "confirms", min(near)[1]))
        elif x.rating is not None and x.rating >= 3.5 and not any(greedy.metres(at(x), at(y)) <= 1000 and alike(x.name, y.name) for y in added):
            added.append(x)
            wanted.append((x.place_id, "added", None))
    found = catalog.queries()["er_match_confirm_add"](spark, SF).collect()
    assert sorted((r.place_id, r.status, r.confirms or -1) for r in found) == sorted((i, s, c or -1) for i, s, c in wanted)


def test_itinerary(spark):
    """The best five sights of every group of three or more, in an order that no other one beats."""
    from cartolake.plans.resolution import sights

    s = sorted(sights(Tables(spark, GROUPS_SF)).collect(), key=lambda p: (-p.score, p.place_id))
    at = {p.place_id: (p.lat, p.lon) for p in s}
    taken, groups = set(), {}
    for c in s:
        if c.place_id not in taken:
            members = [m for m in s if m.place_id not in taken and greedy.metres(at[c.place_id], at[m.place_id]) <= 900 and side(*at[c.place_id]) == side(*at[m.place_id])]
            taken |= {m.place_id for m in members}
            if len(members) >= 3:
                groups[c.place_id] = {m.place_id for m in sorted(members, key=lambda m: (-m.score, m.place_id))[:5]}
    found = {}
    for r in sorted(catalog.queries()["pl_itinerary"](spark, GROUPS_SF).collect(), key=lambda r: r.position):
        found.setdefault(r.centre, []).append(r.place_id)
    assert {c: set(order) for c, order in found.items()} == groups and len(groups) > 5
    walk = lambda order: sum(greedy.metres(at[a], at[b]) for a, b in itertools.pairwise(order))
    for order in found.values():
        assert walk(order) <= min(map(walk, itertools.permutations(order))) + 0.01


def test_popular_routes(spark):
    """From the groups and their orders: of the 15 best, the first five that can be walked in 90 minutes."""
    at = {p.place_id: (p.lat, p.lon) for p in Tables(spark, GROUPS_SF).places.collect()}
    orders, wanted = {}, []
    for r in sorted(catalog.queries()["pl_itinerary"](spark, GROUPS_SF).collect(), key=lambda r: r.position):
        orders.setdefault(r.centre, []).append(at[r.place_id])
    for c in sorted(catalog.queries()["pl_clusters"](spark, GROUPS_SF).collect(), key=lambda c: (-c.score, c.centre))[:15]:
        minutes = sum(math.ceil(greedy.metres(a, b) * 1.3 / 75) for a, b in itertools.pairwise(orders[c.centre]))
        if len(orders[c.centre]) >= 3 and minutes <= 90:
            wanted.append((c.centre, c.score, len(orders[c.centre]), minutes))
    found = catalog.queries()["pl_popular_routes"](spark, GROUPS_SF).collect()
    assert [(r.centre, r.score, r.sights, r.minutes) for r in found] == wanted[:5] and len(found) == 5


def test_first_come_among_given_ids(spark):
    """Rivals that are not among the ids don't count; isolated ids stay; nothing at all gives nothing."""
    ids = spark.range(5)
    found = greedy.first_come(ids, spark.createDataFrame([(99, 0), (0, 1), (1, 2)], "before long, after long"))
    assert sorted(x.id for x in found.collect()) == [0, 2, 3, 4]
    assert greedy.first_come(ids.limit(0), spark.createDataFrame([], "before long, after long")).count() == 0


def test_shuffled_best(spark):
    rows = catalog.queries()["topk_then_shuffle"](spark, SF).collect()
    assert len(rows) == 3 and rows == catalog.queries()["topk_then_shuffle"](spark, SF).collect()


def test_rings():
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    edges = [[square[i], square[(i + 1) % 4]] for i in range(4)]
    other = [[(5.0, 5.0), (6.0, 5.0)], [(5.0, 5.0), (5.5, 6.0)], [(6.0, 5.0), (5.5, 6.0)]]
    stray = [[(0.0, 0.0), (9.0, 9.0)], [(9.0, 9.0), (9.0, 8.0)], [(7.0, 7.0)]]
    for seed in range(30):
        r = random.Random(seed)
        ways = [w[::-1] if r.random() < 0.5 else w for w in [*edges, *other, *stray]]
        r.shuffle(ways)
        found = stitched(ways)
        assert sorted(map(area, found)) == [0.5, 4.0] and all(ring[0] == ring[-1] for ring in found)
    assert stitched([]) == [] and stitched([[*square, square[0]]]) == [[*square, square[0]]]


def test_ring_columns(spark):
    """Points inside and distances of random star-shaped outlines, against plain loops."""
    r = random.Random(9)
    rows = []
    for k in range(60):
        n = r.randint(3, 9)
        ring = [(29 + 0.01 * (1 + r.random()) * math.cos(2 * math.pi * i / n), 41 + 0.01 * (1 + r.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        rows.append((k, r.uniform(40.97, 41.03), r.uniform(28.97, 29.03), [*ring, ring[0]]))
    df = spark.createDataFrame(rows, "id int, lat double, lon double, ring array<struct<lon:double,lat:double>>")
    found = df.select("*", geo.inside_point(F.col("ring")).alias("p"), geo.ring_distance(F.col("lat"), F.col("lon"), F.col("ring")).alias("d"))
    found = found.withColumn("inside", geo.in_ring(F.col("p.lat"), F.col("p.lon"), F.col("ring")))

    def inside(x, y, ring):
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in itertools.pairwise(ring)) % 2 == 1

    for row in found.collect():
        ring = [(p.lon, p.lat) for p in row.ring]
        steps = [(a[0] + t / 400 * (b[0] - a[0]), a[1] + t / 400 * (b[1] - a[1])) for a, b in itertools.pairwise(ring) for t in range(401)]
        near = min(math.hypot((x - row.lon) * geo.LON_M, (y - row.lat) * geo.LAT_M) for x, y in steps)
        assert row.inside and row.d <= (0 if inside(row.lon, row.lat, ring) else near) + 1e-6 and (row.d == 0 or row.d > near - 5)


@pytest.mark.parametrize("lat", [0, 45, 60, 80, 89.99, -72])
def test_within_at_any_latitude(spark, lat):
    """All pairs within the radius, around a pole and across the antimeridian too; null coordinates meet nothing."""
    from cartolake.operators.relational import within

    r = random.Random(int(lat))
    wide = min(360.0, 0.04 / max(math.cos(math.radians(lat)), 1e-4))
    points = [(k, max(-90.0, min(90.0, lat + r.uniform(-0.02, 0.02))), (180 + r.uniform(-wide / 2, wide / 2) + 180) % 360 - 180) for k in range(300)]
    df = spark.createDataFrame([*points, (-1, None, 3.0)], "id long, lat double, lon double")
    found = {(x.a.id, x.b.id) for x in within(df, df, 1000, "id", "id").collect()}
    wanted = {(a[0], b[0]) for a in points for b in points if greedy.metres(a[1:], b[1:]) <= 1000}
    assert found == wanted and len(wanted) > 320
    at = points[0][1:]
    assert {x.id for x in df.where(geo.near(F.col("lat"), F.col("lon"), at, 1500)).collect()} == {p[0] for p in points if greedy.metres(at, p[1:]) <= 1500}


def test_null_distances(spark):
    df = spark.createDataFrame([(None, 29.0), (41.0, 29.0)], "lat double, lon double")
    assert [x.d for x in df.select(geo.haversine(F.col("lat"), F.col("lon"), 41.0, 29.0).alias("d")).collect()] == [None, 0.0]
