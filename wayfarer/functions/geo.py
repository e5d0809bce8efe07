"""Distances and coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# The bounding box of valid coordinates, and the wider one used when searching for them.
MIN_LAT, MAX_LAT, MIN_LON, MAX_LON = 8.0, 13.6, 76.0, 80.5
WIDE_BOX = (7.9, 13.7, 76.0, 80.6)


def number(c: Column) -> Column:
    """A double, or null where the value is no finite number."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null where a coordinate is missing."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    half = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), half))
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(known, F.lit(2 * EARTH_KM) * F.asin(F.sqrt(inside)))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float] = (MIN_LAT, MAX_LAT, MIN_LON, MAX_LON)) -> Column:
    low_lat, high_lat, low_lon, high_lon = box
    return F.coalesce(lat.between(low_lat, high_lat) & lon.between(low_lon, high_lon), F.lit(False))


def valid_coordinates(lat: Column, lon: Column) -> Column:
    """``struct(latitude, longitude)`` rounded to six places inside the box, else both null."""
    a, o = number(lat), number(lon)
    ok = in_box(a, o)
    return F.struct(F.when(ok, F.round(a, 6)).alias("latitude"), F.when(ok, F.round(o, 6)).alias("longitude"))


def grid(value: Column, degrees: float) -> Column:
    return F.floor(value / F.lit(degrees)).cast("long")
