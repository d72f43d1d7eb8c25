"""Distances. Each formula belongs to its callers and none stands in for another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def flat_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular metres."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return EARTH_M * F.hypot(x, F.radians(lat2 - lat1))


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def grid_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres for matches of catalogues."""
    return F.hypot((lon2 - lon1) * 111.32 * F.cos(F.radians((lat1 + lat2) / 2)), (lat2 - lat1) * 110.57)


def path_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres along drawn lines."""
    return F.hypot((lon2 - lon1) * 111.32 * F.cos(F.radians((lat1 + lat2) / 2)), (lat2 - lat1) * 111.32)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees clockwise from north of the direction of travel."""
    return F.degrees(F.atan2((lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)), lat2 - lat1))
