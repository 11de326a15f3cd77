"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: str, lng1: str, lat2: str, lng2: str) -> Column:
    """Kilometres between two points in degrees; NULL unless all four are present."""
    a_lat, a_lng, b_lat, b_lng = (F.col(c).cast("double") for c in (lat1, lng1, lat2, lng2))
    half_lat = F.sin(F.radians(b_lat - a_lat) / 2)
    half_lng = F.sin(F.radians(b_lng - a_lng) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(a_lat)) * F.cos(F.radians(b_lat)) * half_lng * half_lng
    # Rounding can push antipodal points a hair past 1. Not least(), which would
    # turn a missing coordinate into 1.
    half_angle = F.asin(F.when(chord > 1, F.lit(1.0)).otherwise(F.sqrt(chord)))
    return F.lit(2 * EARTH_RADIUS_KM) * half_angle
