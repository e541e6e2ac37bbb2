"""Geometry as column expressions: distances, ellipses, cells, circles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = math.pi * EARTH_KM / 180


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the root's argument is clamped to [0, 1]."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def degrees_apart(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2))


def in_ellipse(lat: Column, lon: Column, site_lat: Column, site_lon: Column, km: float) -> Column:
    """Inside the buffer of a site, with 111 km a degree and longitudes scaled at the site."""
    return F.pow((lat - site_lat) / (km / 111.0), 2) + F.pow((lon - site_lon) / (F.lit(km) / (111.0 * F.cos(F.radians(site_lat)))), 2) <= 1


def row_degrees(km: float) -> float:
    """Height, in degrees, of rows of cells no lower than ``km``."""
    return km / KM_PER_DEGREE * 1.0001


def cell(value: Column, degrees: float) -> Column:
    return F.floor(value / degrees).cast("long")


def cells_around(row: Column, high: float) -> Column:
    """How many cells, each at least as wide as high, a row holds around the globe; the row's neighbours count as its own,
    so that points of any two neighbouring rows within ``high`` of each other lie at most one cell apart."""
    reach = F.least(F.lit(90.0), F.greatest(F.abs(row - 1), F.abs(row + 2)) * high)
    n = F.floor(360.0 * F.cos(F.radians(reach)) / (high * 1.05)).cast("long")
    return F.when(n < 12, 1).otherwise(n).cast("long")


def cell_in_row(lon: Column, around: Column) -> Column:
    """The cell of a longitude, counted eastward from the antimeridian."""
    return F.pmod(F.floor((lon + 180.0) / 360.0 * around).cast("long"), around)


def tile_high(km: float) -> float:
    """Height, in degrees, of tiles whose points are all within ``km`` of each other."""
    return km / KM_PER_DEGREE / math.sqrt(2) * 0.99


def tile_wide(row: Column, km: float) -> Column:
    """Width, in degrees, of the tiles of a row."""
    high = tile_high(km)
    return high / F.cos(F.radians(F.least(F.abs(row), F.abs(row + 1)) * high))


def tile(lat: Column, lon: Column, km: float) -> Column:
    """A tile (row, column) whose points are all within ``km`` of each other."""
    row = cell(lat, tile_high(km))
    return F.struct(row.alias("y"), F.floor(lon / tile_wide(row, km)).cast("long").alias("x"))


def circle(lat: Column, lon: Column, metres: Column, corners: int = 32) -> Column:
    """Closed ring of [lon, lat] vertices, rounded to seven places; the first one east of the centre."""
    def vertex(i):
        angle = i * (2 * math.pi / corners)
        dlat = metres * F.sin(angle) / 111_320.0
        dlon = metres * F.cos(angle) / (111_320.0 * F.cos(F.radians(lat)))
        return F.array(F.round(lon + dlon, 7), F.round(lat + dlat, 7))

    return F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda i: vertex(F.pmod(i, F.lit(corners))))
