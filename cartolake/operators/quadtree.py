"""Points in polygons by coverings of variable depth.

A polygon is covered by quadtree cells, at most a given number of them: cells that its outline meets are split, the largest first,
cells wholly inside stay large and cells outside go. So a country's outline costs as many cells as a village's, and points in
its inside are decided by their cell alone. A point looks itself up once for each depth that coverings have, every second
one of the tree's; only those in cells on an outline are tested exactly. Deep cells where outlines are dense spread hot places.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.functions.geo import in_polygon

#: Depths of cells: 360 / 2^depth degrees wide and half as high; the deepest is some 20 metres.
SHALLOWEST, DEEPEST, STEP = 2, 20, 2
#: Cells of a covering at most.
CELLS = 256
#: By how much a cell is widened when outlines are tested against it, in degrees.
MARGIN = 1e-9


def _meets(edges: np.ndarray, west: float, south: float, east: float, north: float) -> np.ndarray:
    """Which edges (x1, y1, x2, y2) touch a box: their own box does, and the box's corners are not all on one side of their line."""
    x1, y1, x2, y2 = edges.T
    near = (np.maximum(x1, x2) >= west) & (np.minimum(x1, x2) <= east) & (np.maximum(y1, y2) >= south) & (np.minimum(y1, y2) <= north)
    sides = np.stack([(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (west, east) for y in (south, north)])
    return near & (sides.min(axis=0) <= 0) & (sides.max(axis=0) >= 0)


def _inside(edges: np.ndarray, x: float, y: float) -> bool:
    x1, y1, x2, y2 = edges.T
    with np.errstate(divide="ignore", invalid="ignore"):
        crossed = ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) / (y2 - y1) * (x2 - x1))
    return bool(crossed.sum() % 2)


def covering(rings: list, most: int = CELLS) -> list[tuple[int, int, int, bool]]:
    """(depth, x, y, whole) of disjoint cells that hold all of a polygon; `whole` ones lie inside. rings: arrays of (lon, lat), closed."""
    edges = np.concatenate([np.concatenate([p[:-1], p[1:]], axis=1) for p in (np.asarray(r, np.float64).reshape(-1, 2) for r in rings) if len(p) > 1] or [np.zeros((0, 4))])
    out, queue = [], []

    def look(depth: int, x: int, y: int, some: np.ndarray) -> None:
        width, height = 360 / 2**depth, 180 / 2**depth
        west, south = x * width - 180, y * height - 90
        met = some[_meets(some, west - MARGIN, south - MARGIN, west + width + MARGIN, south + height + MARGIN)] if len(some) else some
        if len(met):
            heapq.heappush(queue, (depth, -len(met), x, y, met.tobytes()))
        elif len(edges) and _inside(edges, west + width / 2, south + height / 2):
            out.append((depth, x, y, True))

    for x in range(2**SHALLOWEST):
        for y in range(2**SHALLOWEST):
            look(SHALLOWEST, x, y, edges)
    children = 4**STEP
    while queue:
        depth, _, x, y, met = queue[0]
        if depth + STEP > DEEPEST or len(out) + len(queue) + children - 1 > most:
            break
        heapq.heappop(queue)
        some = np.frombuffer(met).reshape(-1, 4)
        for i in range(2**STEP):
            for j in range(2**STEP):
                look(depth + STEP, (x << STEP) + i, (y << STEP) + j, some)
    return out + [(depth, x, y, False) for depth, _, x, y, _ in queue]


def coverings(polygons: DataFrame, most: int = CELLS) -> DataFrame:
    """id, depth, x, y, whole of polygons (id, rings: arrays of structs lon, lat)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[] if rings is None else covering([[(p["lon"], p["lat"]) for p in r] for r in rings], most) for rings in batch.column(1).to_pylist()]
            ids = batch.column(0).take(pa.array([k for k, cells in enumerate(made) for _ in cells], pa.int64()))
            flat = [c for cells in made for c in cells]
            columns = [pa.array([c[n] for c in flat], kind) for n, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["id", "depth", "x", "y", "whole"])

    return polygons.select("id", "rings").mapInArrow(work, f"id {polygons.schema['id'].dataType.simpleString()}, depth int, x long, y long, whole boolean")


def _cell(lat: Column, lon: Column, depth: int) -> Column:
    side = 2**depth
    place = lambda share: F.least(F.floor(share * side), F.lit(side - 1).cast("long"))
    return F.struct(F.lit(depth).alias("depth"), place((lon + 180) / 360).alias("x"), place((lat + 90) / 180).alias("y"))


def points_in(points: DataFrame, polygons: DataFrame, most: int = CELLS) -> DataFrame:
    """The rows of points (lat, lon and others) with `found`, the id of each polygon (id, rings) that holds them; points in none are left out.

    A null coordinate is in no polygon. Outlines are joined only to points in cells on an outline.
    """
    cells = coverings(polygons, most).withColumnRenamed("id", "found")
    depths = F.array(*[_cell(F.col("lat"), F.col("lon"), d) for d in range(SHALLOWEST, DEEPEST + 1, STEP)])
    asked = points.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.struct(*points.columns).alias("p"), F.explode(depths).alias("c"))
    met = asked.select("p", "c.depth", "c.x", "c.y").join(cells, ["depth", "x", "y"]).select("p", "found", "whole")
    edge = met.where("NOT whole").join(polygons.select(F.col("id").alias("found"), "rings"), "found").where(in_polygon(F.col("p.lat"), F.col("p.lon"), F.col("rings")))
    return met.where("whole").select("p.*", "found").unionByName(edge.select("p.*", "found"))
