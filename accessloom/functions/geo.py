"""Locations on the globe and the clock: coordinates, borders, time zones and the least time to travel."""

from __future__ import annotations

import functools
from math import asin, ceil, cos, radians, sin, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .values import whole

# Representative latitude and longitude, minutes ahead of UTC, and pairs that share a border.
PLACES = {
    "US": (39.8283, -98.5795), "VN": (14.0583, 108.2772), "JP": (36.2048, 138.2529), "KR": (35.9078, 127.7669),
    "SG": (1.3521, 103.8198), "CN": (35.8617, 104.1954), "DE": (51.1657, 10.4515), "FR": (46.2276, 2.2137),
    "UK": (55.3781, -3.4360), "AU": (-25.2744, 133.7751), "CA": (56.1304, -106.3468), "IN": (20.5937, 78.9629),
    "BR": (-14.2350, -51.9253), "RU": (61.5240, 105.3188), "TH": (15.8700, 100.9925),
}
OFFSETS = {"VN": 420, "US": -300, "JP": 540, "KR": 540, "SG": 480, "CN": 480, "DE": 60, "FR": 60, "UK": 0, "AU": 600, "CA": -300, "IN": 330, "BR": -180, "RU": 180, "TH": 420}
BORDERS = (("US", "CA"), ("VN", "CN"), ("CN", "IN"), ("CN", "RU"), ("DE", "FR"))
EARTH_KM, SPEED_KMH, HANDLING_H = 6371.0, 900.0, 2.0


def distance_km(a: str, b: str) -> float:
    """Great-circle distance."""
    (lat_a, lon_a), (lat_b, lon_b) = PLACES[a], PLACES[b]
    h = sin(radians(lat_b - lat_a) / 2) ** 2 + cos(radians(lat_a)) * cos(radians(lat_b)) * sin(radians(lon_b - lon_a) / 2) ** 2
    return 2 * EARTH_KM * asin(sqrt(h))


@functools.cache
def least_seconds() -> dict[tuple[str, str], int]:
    """Least travel time of every pair of different places without a common border."""
    near = {frozenset(p) for p in BORDERS}
    return {(a, b): ceil((distance_km(a, b) / SPEED_KMH + HANDLING_H) * 3600) for a in PLACES for b in PLACES if a != b and frozenset((a, b)) not in near}


def travel(spark: SparkSession) -> DataFrame:
    """The table of least travel times: at most 15 x 14 rows."""
    return spark.createDataFrame([(a, b, s) for (a, b), s in least_seconds().items()], "origin string, location string, least_sec long")


def offset_minutes(location: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in OFFSETS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, location), F.lit(0))


def local_hour(seconds: Column, location: Column) -> Column:
    return whole(F.pmod(F.pmod(seconds, F.lit(86400)) + offset_minutes(location) * 60, F.lit(86400)), F.lit(3600))
