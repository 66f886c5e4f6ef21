"""Distance, bearing and range checks on coordinates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS-84.
EQUATOR_RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points on the WGS-84 ellipsoid (Lambert's formula for long lines)."""
    u1 = F.atan((1 - FLATTENING) * F.tan(F.radians(lat1)))
    u2 = F.atan((1 - FLATTENING) * F.tan(F.radians(lat2)))
    half_lat = F.sin((u2 - u1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(u1) * F.cos(u2) * half_lon * half_lon
    sigma = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    mid, dif = (u1 + u2) / 2, (u2 - u1) / 2
    x = (sigma - F.sin(sigma)) * F.pow(F.sin(mid) * F.cos(dif) / F.cos(sigma / 2), 2)
    y = (sigma + F.sin(sigma)) * F.pow(F.cos(mid) * F.sin(dif) / F.sin(sigma / 2), 2)
    far = EQUATOR_RADIUS * (sigma - FLATTENING / 2 * (x + y))
    return F.when(sigma == 0, F.lit(0.0)).otherwise(far)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial compass bearing, 0 to 360 degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    turn = F.radians(lon2 - lon1)
    east = F.sin(turn) * F.cos(b)
    north = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def in_range(lat: Column, lon: Column) -> Column:
    """True for latitudes in [-90, 90] and longitudes in [-180, 180]."""
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
