"""Great-circle distance as a Column expression (stays in codegen)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_UNIT = {"km": 1.0, "mi": 1.609344}


def haversine_km(lat1: Column, lon1: Column, lat2: Column | float, lon2: Column | float) -> Column:
    lat2 = F.lit(lat2) if not isinstance(lat2, Column) else lat2
    lon2 = F.lit(lon2) if not isinstance(lon2, Column) else lon2
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = (F.pow(F.sin(dlat / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


# ---- grid cells: a location's cell, and the cells a circle can touch ---------------

CELL_DEGREES = 1.0
#: Cell of a location that is no point on the globe; every search looks at these too.
NO_CELL = -1


def cell_of(lat: Column, lon: Column, step: float = CELL_DEGREES) -> Column:
    """Number of the grid cell of a point, row by row from the south; cells of a row are consecutive."""
    across = round(360 / step)
    row = F.least(F.floor((lat + 90.0) / step), F.lit(round(180 / step) - 1))
    # Longitudes wrap; the remainder of a tiny negative one may round up to a full turn.
    col = F.least(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / step), F.lit(across - 1))
    good = lat.between(-90.0, 90.0) & (F.abs(lon) <= 1e6)
    return F.when(good, row * across + col).otherwise(F.lit(NO_CELL)).cast("long")


def covering_cells(lat: float, lon: float, km: float, step: float = CELL_DEGREES) -> list[tuple[int, int]]:
    """Ranges of cells (both ends inclusive) that a circle touches, at least; two a row where
    it crosses the date line, whole rows where it holds a pole."""
    across, down, slack = round(360 / step), round(180 / step), 1e-6
    angle = km / EARTH_RADIUS_KM + math.radians(slack)
    south, north = lat - math.degrees(angle), lat + math.degrees(angle)
    first = max(0, math.floor((south + 90) / step))
    last = min(down - 1, math.floor((north + 90) / step))
    if south <= -90 or north >= 90 or angle >= math.pi / 2:
        return [(first * across, (last + 1) * across - 1)]
    half = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat))))) + slack
    west, east = lon - half, lon + half
    if east - west + step >= 360:
        return [(first * across, (last + 1) * across - 1)]
    a = math.floor(((west + 180) % 360) / step) % across
    z = math.floor(((east + 180) % 360) / step) % across
    spans = [(a, z)] if a <= z else [(0, z), (a, across - 1)]
    return [(row * across + x, row * across + y) for row in range(first, last + 1) for x, y in spans]


def in_cells(cell: Column, ranges: list[tuple[int, int]]) -> Column:
    """A filter on the cell column that reaches the scan."""
    out = cell == NO_CELL
    for a, z in ranges:
        out = out | cell.between(a, z)
    return out
