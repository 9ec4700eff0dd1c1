"""Points written ``lat_lon`` in degrees, and their distance to boxes and circles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def latitude(c: Column) -> Column:
    return F.split_part(c, F.lit("_"), F.lit(1)).try_cast("double")


def longitude(c: Column) -> Column:
    return F.split_part(c, F.lit("_"), F.lit(2)).try_cast("double")


def _point(text: str) -> tuple[float, float]:
    lat, lon = str(text).split("_")
    return float(lat), float(lon)


def in_box(c: Column, low: str, high: str) -> Column:
    (south, west), (north, east) = _point(low), _point(high)
    return latitude(c).between(south, north) & longitude(c).between(west, east)


def in_circle(c: Column, centre: str, radius: float) -> Column:
    """Planar distance in degrees."""
    lat, lon = _point(centre)
    return F.pow(latitude(c) - lat, 2) + F.pow(longitude(c) - lon, 2) <= F.lit(radius * radius)
