"""Spatial functions on plain structs: a point is struct<lat:double, lon:double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._util import c

# Mean Earth radius per unit.
EARTH_RADIUS = {"km": 6371.0088, "kilometers": 6371.0088, "mi": 3958.7613, "miles": 3958.7613,
                "m": 6371008.8, "meters": 6371008.8}


def makepoint(lat, lon) -> Column:
    return F.struct(c(lat).cast("double").alias("lat"), c(lon).cast("double").alias("lon"))


def makeline(p1, p2) -> Column:
    return F.array(c(p1), c(p2))


def half_chord(lat1, lon1, cos1, lat2, lon2, cos2) -> Column:
    """Squared half chord of two points: latitudes and longitudes in radians, and the latitudes' cosines."""
    up, across = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    a = up * up + cos1 * cos2 * (across * across)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))


def arc(a, unit: str = "km") -> Column:
    """Great-circle distance of a squared half chord."""
    return 2 * EARTH_RADIUS[unit] * F.asin(F.sqrt(a))


def distance(p1, p2, unit: str = "km") -> Column:
    """Great-circle (haversine) distance between two points."""
    p1, p2 = c(p1), c(p2)
    lat1, lat2 = F.radians(p1["lat"]), F.radians(p2["lat"])
    return arc(half_chord(lat1, F.radians(p1["lon"]), F.cos(lat1), lat2, F.radians(p2["lon"]), F.cos(lat2)), unit)


def area(points) -> Column:
    """Planar polygon area (shoelace) of an array of points, in squared degrees."""
    pts = c(points)
    n = F.size(pts)
    idx = F.sequence(F.lit(0), n - 1)
    terms = F.transform(idx, lambda i: pts[i]["lon"] * pts[(i + 1) % n]["lat"]
                        - pts[(i + 1) % n]["lon"] * pts[i]["lat"])
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    return F.when(n >= 3, F.abs(total) / 2)
