"""Great-circle distance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a mile, the sphere's radius in metres.
MILE, RADIUS = 1609.344, 6378168.0


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points on the sphere (haversine)."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return 2 * RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def box(lat: float, lon: float, metres: float) -> Column:
    """That ``lat`` and ``lon`` lie in the box around all points so near: ranges of columns, which a scan can use."""
    reach = math.degrees(metres / RADIUS) * (1 + 1e-9) + 1e-9
    inside = F.col("lat").between(lat - reach, lat + reach)
    if abs(lat) + reach >= 90:  # holds a pole
        return inside
    wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(lat))))) * (1 + 1e-9) + 1e-9
    west, east = lon - wide, lon + wide
    across = F.col("lon").between(west, east)
    if west < -180:
        across = across | (F.col("lon") >= west + 360)
    if east > 180:
        across = across | (F.col("lon") <= east - 360)
    return inside & across


def distance_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)"
    return f"2 * {RADIUS} * asin(least(1.0, sqrt({h})))"
