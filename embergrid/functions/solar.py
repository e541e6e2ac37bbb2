"""Solar geometry as column expressions, from the low-precision formulas of the astronomical almanac."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SATELLITE_LON = 140.7
SATELLITE_KM = 35_786.0
EARTH_KM = 6371.0


def _sun(t: Column) -> tuple[Column, Column, Column]:
    """Right ascension, declination (radians) and Greenwich sidereal time (degrees)."""
    days = (t.cast("double") - 946_728_000.0) / 86_400.0
    mean = F.radians(F.pmod(357.528 + 0.9856003 * days, F.lit(360.0)))
    lon = F.radians(F.pmod(280.460 + 0.9856474 * days + 1.915 * F.sin(mean) + 0.020 * F.sin(2 * mean), F.lit(360.0)))
    tilt = F.radians(23.439 - 0.0000004 * days)
    return F.atan2(F.cos(tilt) * F.sin(lon), F.cos(lon)), F.asin(F.sin(tilt) * F.sin(lon)), F.pmod(280.46061837 + 360.98564736629 * days, F.lit(360.0))


def _angles(t: Column, lat: Column, lon: Column) -> tuple[Column, Column, Column, Column]:
    ra, dec, gmst = _sun(t)
    hour = F.radians(gmst + lon) - ra
    return hour, dec, F.sin(F.radians(lat)), F.cos(F.radians(lat))


def solar_zenith(t: Column, lat: Column, lon: Column) -> Column:
    """Degrees from the zenith."""
    hour, dec, s, c = _angles(t, lat, lon)
    x = s * F.sin(dec) + c * F.cos(dec) * F.cos(hour)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))))


def solar_azimuth(t: Column, lat: Column, lon: Column) -> Column:
    """Degrees clockwise from north."""
    hour, dec, s, c = _angles(t, lat, lon)
    return F.pmod(F.degrees(F.atan2(-F.sin(hour) * F.cos(dec), F.sin(dec) * c - F.cos(dec) * s * F.cos(hour))), F.lit(360.0))


def is_day(sza: Column, limit: float = 85.0) -> Column:
    return sza < limit


def local_solar_hour(t: Column, lon: Column) -> Column:
    """Hours of local solar time in [0, 24)."""
    return F.pmod(F.pmod(t.cast("double"), F.lit(86_400.0)) / 3600.0 + lon / 15.0, F.lit(24.0))


def is_day_by_hour(t: Column, lon: Column) -> Column:
    """The offline tools' day: six to eighteen hours of local solar time, both included."""
    return local_solar_hour(t, lon).between(6, 18)


def harmonic_row(hour: Column, anomaly: Column) -> Column:
    w = 2 * math.pi / 24
    return F.array(F.lit(1.0), F.cos(w * hour), F.sin(w * hour), F.cos(2 * w * hour), F.sin(2 * w * hour), anomaly)


def glint_angle(t: Column, lat: Column, lon: Column) -> Column:
    """Degrees between the mirrored sun and the direction to the satellite."""
    sza = F.radians(solar_zenith(t, lat, lon))
    saa = F.radians(solar_azimuth(t, lat, lon))
    dlon = F.radians(F.lit(SATELLITE_LON) - lon)
    la = F.radians(lat)
    centre = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(la) * F.cos(dlon))))
    vza = F.atan2(F.sin(centre), F.cos(centre) - EARTH_KM / (EARTH_KM + SATELLITE_KM))
    vaa = F.atan2(F.sin(dlon), -F.sin(la) * F.cos(dlon))
    x = F.cos(sza) * F.cos(vza) - F.sin(sza) * F.sin(vza) * F.cos(saa - vaa)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))))
