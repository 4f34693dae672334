"""Geometry as column expressions: great-circle distances, polygons, grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"2*{EARTH_M}::DOUBLE*asin(sqrt(pow(sin(radians({lat2}-{lat1})/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2),2)))"


def in_ring(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting against a closed ring of (lon, lat) corners."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            hit = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < F.lit((x2 - x1) / (y2 - y1)) * (lat - F.lit(y1)) + F.lit(x1))
            crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def in_ring_sql(lat: str, lon: str, ring: list[tuple[float, float]]) -> str:
    parts = [f"((({y1!r}::DOUBLE > {lat}) <> ({y2!r}::DOUBLE > {lat})) AND {lon} < ({(x2 - x1) / (y2 - y1)!r})::DOUBLE*({lat}-{y1!r}::DOUBLE)+{x1!r}::DOUBLE)::INT" for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True) if y1 != y2]
    return f"({' + '.join(parts)}) % 2 = 1"


class Grid:
    """Cells on the globe for joins within a radius: bands of latitude, each cut into as many cells as it needs.

    Two points within the radius are in the same or neighbouring bands, and in
    either band's cells at most one apart, around the globe and at the poles
    too.
    """

    def __init__(self, metres: float):
        self.angle = min(metres / EARTH_M, math.pi / 2)
        self.height = math.degrees(self.angle) * (1 + 1e-9)
        self.bands = math.ceil(180.0 / self.height)

    def band(self, lat: Column) -> Column:
        return F.least(F.floor((lat + 90.0) / F.lit(self.height)).cast("bigint"), F.lit(self.bands - 1).cast("bigint"))

    def _count(self, band: Column) -> Column:
        """Cells of a band: each spans the longitudes that the radius does at the farthest latitude of the band's neighbours.

        That is asin(sin r / cos lat), which is at most pi / 2 times its argument.
        """
        middle = F.abs(band * F.lit(self.height) - F.lit(90.0 - self.height / 2))
        far = F.least(middle + F.lit(1.5 * self.height), F.lit(90.0))
        return F.greatest(F.floor(F.cos(F.radians(far)) * F.lit(4.0 / math.sin(self.angle) * (1 - 1e-9))), F.lit(1)).cast("bigint")

    def _column(self, lon: Column, count: Column) -> Column:
        return F.pmod(F.floor((lon + 180.0) / 360.0 * count).cast("bigint"), count)

    def cell(self, lat: Column, lon: Column) -> Column:
        """struct(y, x) of a point."""
        band = self.band(lat)
        return F.struct(band.alias("y"), self._column(lon, self._count(band)).alias("x"))

    def around(self, lat: Column, lon: Column) -> Column:
        """Distinct cells that hold every point within the radius, nine at most."""
        own, found = self.band(lat), []
        for dy in (-1, 0, 1):
            band = own + dy
            count = self._count(band)
            for dx in (-1, 0, 1):
                found.append(F.struct(band.alias("y"), F.pmod(self._column(lon, count) + dx, count).alias("x")))
        return F.array_distinct(F.array(*found))
