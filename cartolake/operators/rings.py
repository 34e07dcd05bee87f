"""Closed rings from the ways of one outline."""

from __future__ import annotations

Point = tuple[float, float]


def stitched(ways: list[list[Point]]) -> list[list[Point]]:
    """Closed rings (first point repeated) that the ways form when laid end to end, in any order and direction.

    At each end the walk goes on with the first unused way that starts or ends there. Where the walk meets itself, what lies
    between is a ring and is taken out; where no way goes on, the one that led there is dropped as a dead end.
    """
    ends: dict[Point, list[int]] = {}
    for n, way in enumerate(ways):
        if len(way) > 1:
            for p in (way[0], way[-1]):
                ends.setdefault(p, []).append(n)
    used, rings = set(), []
    for first, way in enumerate(ways):
        if first in used or len(way) < 2:
            continue
        used.add(first)
        path = [list(way)]
        while path:
            here = path[-1][-1]
            met = next((n for n, part in enumerate(path) if part[0] == here), None)
            if met is not None:
                ring = [here, *(p for part in path[met:] for p in part[1:])]
                if len(ring) > 3:
                    rings.append(ring)
                del path[met:]
                continue
            on = next((n for n in ends[here] if n not in used), None)
            if on is None:
                path.pop()
                continue
            used.add(on)
            path.append(list(ways[on]) if ways[on][0] == here else list(ways[on])[::-1])
    return rings


def area(ring: list[Point]) -> float:
    """Area of a closed ring in the square of its unit."""
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))) / 2
