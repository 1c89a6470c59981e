"""Great-circle distance and evenly spaced points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in km between two points given in degrees."""
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def linspace(low: Column, high: Column, n: int) -> Column:
    """Array of ``n`` evenly spaced numbers from ``low`` to ``high``, both included."""
    if n < 1:
        raise ValueError("n must be at least 1")
    if n == 1:
        return F.array(low)
    step = (high - low) / (n - 1)
    inner = F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: low + i * step)
    return F.concat(inner, F.array(high))
