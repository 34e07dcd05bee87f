"""Which side of the Bosphorus a point is on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The strait's middle from north to south, latitude and longitude, and the box of the province.
MIDLINE = (
    (41.25, 29.130), (41.20, 29.100), (41.17, 29.072), (41.15, 29.075), (41.12, 29.080), (41.10, 29.060), (41.083, 29.061),
    (41.075, 29.051), (41.065, 29.052), (41.046, 29.036), (41.035, 29.008), (41.02, 28.995), (41.00, 29.000), (40.80, 29.000),
)
SOUTH, NORTH, WEST, EAST = 40.72, 41.69, 27.95, 29.98


def midline(lat: Column) -> Column:
    """Longitude of the middle at a latitude, linear between the known points and constant beyond."""
    out = F.when(lat >= MIDLINE[0][0], F.lit(MIDLINE[0][1]))
    for (y1, x1), (y0, x0) in zip(MIDLINE, MIDLINE[1:], strict=False):
        out = out.when(lat >= y0, F.lit(x0) + (lat - y0) / (y1 - y0) * (x1 - x0))
    return out.otherwise(F.lit(MIDLINE[-1][1]))


def in_province(lat: Column, lon: Column) -> Column:
    return lat.between(SOUTH, NORTH) & lon.between(WEST, EAST)


def same_side(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """True as well where there is no strait to cross."""
    return ~(in_province(lat1, lon1) & in_province(lat2, lon2)) | ((lon1 > midline(lat1)) == (lon2 > midline(lat2)))
