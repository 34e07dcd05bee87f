"""Polygons in the plane by a sweep: crossing lines are noded, regions are read slab by slab, outlines are put together.

Between two neighbouring abscissas at which anything starts, ends or crosses, segments have one order from bottom to top. A
region's part of such a slab is a few trapezoids, its area their sum, and its outline the segments where inside meets outside,
with the upright pieces between slabs. A region is what any of several polygons covers, or what lies on the odd side
of all lines together.
"""

from __future__ import annotations

import math
from bisect import insort

from cartolake.operators.rings import area, stitched

Point = tuple[float, float]
Segment = tuple[Point, Point]
#: Decimals to which points are snapped: a tenth of a millimetre in degrees.
DECIMALS = 9


def snapped(p: Point) -> Point:
    return round(p[0], DECIMALS) + 0.0, round(p[1], DECIMALS) + 0.0


def segments(lines: list[list[Point]]) -> list[Segment]:
    """The pieces of lines, each from left to right (bottom to top if upright), snapped; points repeated are no pieces."""
    out = []
    for line in lines:
        points = [snapped(p) for p in line]
        out += [(min(a, b), max(a, b)) for a, b in zip(points, points[1:], strict=False) if a != b]
    return out


def _cross(o: Point, a: Point, b: Point) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _meetings(s: Segment, t: Segment) -> list[Point]:
    """Where two segments meet: a point, the ends of what they share, or nothing. Ends within the snap of the other count."""
    (a, b), (c, d) = s, t
    if max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
        return []
    near = 10.0**-DECIMALS
    length = lambda p, q: max(abs(p[0] - q[0]), abs(p[1] - q[1]))
    on = lambda p, q, r: abs(_cross(q, r, p)) <= near * length(q, r) and min(q, r) <= p <= max(q, r) and min(q[1], r[1]) - near <= p[1] <= max(q[1], r[1]) + near
    found = [p for p, q, r in ((a, c, d), (b, c, d), (c, a, b), (d, a, b)) if on(p, q, r)]
    if found:
        return found
    u, v = _cross(a, b, c), _cross(a, b, d)
    x, y = _cross(c, d, a), _cross(c, d, b)
    if u * v < 0 and x * y < 0:
        at = x / (x - y)
        return [snapped((a[0] + at * (b[0] - a[0]), a[1] + at * (b[1] - a[1])))]
    return []


def noded(given: list[tuple[Segment, int]]) -> dict[Segment, list[int]]:
    """Segments cut at all their meetings, and the owners of each piece (as often as each has it). A sweep from left to right
    compares those only that lie over each other."""
    order = sorted(given, key=lambda g: g[0][0][0])
    cuts: list[list[Point]] = [[] for _ in order]
    active: list[int] = []
    for k, ((a, b), _) in enumerate(order):
        active = [j for j in active if order[j][0][1][0] >= a[0]]
        for j in active:
            points = _meetings((a, b), order[j][0])
            cuts[k] += points
            cuts[j] += points
        active.append(k)
    out: dict[Segment, list[int]] = {}
    for ((a, b), owner), points in zip(order, cuts, strict=True):
        every = sorted({a, b, *points})
        for p, q in zip(every, every[1:], strict=False):
            out.setdefault((p, q), []).append(owner)
    return out


def closed_only(pieces: list[Segment]) -> list[Segment]:
    """Pieces that lie on some closed way; loose ends go, and what only joins one ring to another."""
    at: dict[Point, list[int]] = {}
    for k, (a, b) in enumerate(pieces):
        at.setdefault(a, []).append(k)
        at.setdefault(b, []).append(k)
    seen: dict[Point, int] = {}
    low: dict[Point, int] = {}
    bridges: set[int] = set()
    for root in at:
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        path = [(root, -1, iter(at[root]))]
        while path:
            p, came, rest = path[-1]
            for k in rest:
                if k == came:
                    continue
                q = pieces[k][1] if pieces[k][0] == p else pieces[k][0]
                if q in seen:
                    low[p] = min(low[p], seen[q])
                else:
                    seen[q] = low[q] = len(seen)
                    path.append((q, k, iter(at[q])))
                    break
            else:
                path.pop()
                if path:
                    before = path[-1][0]
                    low[before] = min(low[before], low[p])
                    if low[p] > seen[before]:
                        bridges.add(came)  # nothing behind it leads back
    return [s for k, s in enumerate(pieces) if k not in bridges]


def _height(s: Segment, x: float) -> float:
    (ax, ay), (bx, by) = s
    return ay if x == ax else by if x == bx else ay + (by - ay) * (x - ax) / (bx - ax)


def slabs(pieces: dict[Segment, list[int]], any_covers: bool):
    """x0, x1 and the region's part between them: pairs of a lower and an upper piece.

    any_covers: inside is where any owner's own lines have been crossed an odd number of times; else where all lines together have.
    """
    slanted = sorted((s for s in pieces if s[0][0] < s[1][0]), key=lambda s: s[0][0])
    xs = sorted({p[0] for s in pieces for p in s})
    active: list[Segment] = []
    at = 0
    for x0, x1 in zip(xs, xs[1:], strict=False):
        active = [s for s in active if s[1][0] > x0]
        while at < len(slanted) and slanted[at][0][0] <= x0:
            active.append(slanted[at])
            at += 1
        middle = (x0 + x1) / 2
        inside: set[int] = set()
        lower, parts = None, []
        for s in sorted(active, key=lambda s: _height(s, middle)):
            before = bool(inside)
            for owner in pieces[s] if any_covers else [0] * len(pieces[s]):
                inside ^= {owner}
            if bool(inside) != before:
                if not before:
                    lower = s
                else:
                    parts.append((lower, s))
        yield x0, x1, parts


def covered(pieces: dict[Segment, list[int]], any_covers: bool, between: tuple[float, float] = (-math.inf, math.inf)) -> float:
    """Area of the region, or of its part between two abscissas."""
    total = 0.0
    for left, right, parts in slabs(pieces, any_covers):
        x0, x1 = max(left, between[0]), min(right, between[1])
        if x0 < x1:
            total += sum((x1 - x0) * (_height(top, x0) - _height(low, x0) + _height(top, x1) - _height(low, x1)) / 2 for low, top in parts)
    return total


def outline(pieces: dict[Segment, list[int]], any_covers: bool) -> list[list[Point]]:
    """The rings of the region, without points inside straight runs. Upright pieces are where the slabs on both sides differ."""
    edges: list[list[Point]] = []
    last, end = [], None
    for x0, x1, parts in [*slabs(pieces, any_covers), (None, None, [])]:
        x = x0 if x0 is not None else end
        if x is None:
            break
        marks: list[tuple[float, int]] = []
        for spans, side in ((last, 1), (parts, 2)):
            for low, top in spans:
                insort(marks, (snapped((0, _height(low, x)))[1], side))
                insort(marks, (snapped((0, _height(top, x)))[1], side))
        state, from_ = 0, None
        for y, side in marks:
            # Between two marks the line is outline if just one side is inside.
            if state in (1, 2) and from_ is not None and y != from_:
                edges.append([(x, from_), (x, y)])
            state ^= side
            from_ = y
        for low, top in parts:
            edges += [[snapped((x0, _height(s, x0))), snapped((x1, _height(s, x1)))] for s in (low, top)]
        last, end = parts, x1
    return [r for r in (_straightened(r) for r in stitched(edges)) if len(r) > 3]


def _straightened(ring: list[Point]) -> list[Point]:
    points = ring[:-1]
    kept = []
    for k, p in enumerate(points):
        before, after = points[k - 1], points[(k + 1) % len(points)]
        if abs(_cross(before, p, after)) > 10.0**-DECIMALS * max(abs(after[0] - before[0]), abs(after[1] - before[1]), 10.0**-DECIMALS):
            kept.append(p)
    return [*kept, kept[0]] if kept else []


def united(polygons: list[list[list[Point]]]) -> list[list[Point]]:
    """The outline of what any of the polygons covers; a polygon is its rings, holes among them."""
    return outline(noded([(s, k) for k, rings in enumerate(polygons) for s in segments(rings)]), True)


def united_area(polygons: list[list[list[Point]]], between: tuple[float, float] = (-math.inf, math.inf)) -> float:
    return covered(noded([(s, k) for k, rings in enumerate(polygons) for s in segments(rings)]), True, between)


def built(ways: list[list[Point]]) -> list[list[list[Point]]]:
    """Polygons (a shell and its holes) from ways in any order and direction, which may cross or overshoot each other.

    Ways are noded, what is on no closed way goes, and what lies on the odd side of the lines is inside. Of the region's rings those that lie in
    an even number of others are shells; the others are holes of the smallest ring around them.
    """
    pieces = noded([(s, 0) for s in segments(ways)])
    once = {s: [0] for s in closed_only(sorted(pieces))}
    rings = sorted(outline(once, False), key=area)
    around = [[j for j in range(k + 1, len(rings)) if _holds(rings[j], rings[k])] for k in range(len(rings))]
    shells = {k: [rings[k]] for k in range(len(rings)) if len(around[k]) % 2 == 0}
    for k in range(len(rings)):
        if k not in shells:
            shells[around[k][0]].append(rings[k])
    return [shells[k] for k in sorted(shells, reverse=True)]


def _holds(ring: list[Point], inner: list[Point]) -> bool:
    """Whether a ring that does not cross another has it inside: by a point in the middle of an edge that is not on the ring."""
    for (ax, ay), (bx, by) in zip(inner, inner[1:], strict=False):
        p = ((ax + bx) / 2, (ay + by) / 2)
        edges = list(zip(ring, ring[1:], strict=False))
        if any(abs(_cross(c, d, p)) <= 1e-12 and min(c[0], d[0]) <= p[0] <= max(c[0], d[0]) and min(c[1], d[1]) <= p[1] <= max(c[1], d[1]) for c, d in edges):
            continue
        return sum((c[1] > p[1]) != (d[1] > p[1]) and p[0] < c[0] + (p[1] - c[1]) / (d[1] - c[1]) * (d[0] - c[0]) for c, d in edges) % 2 == 1
    return False
