"""Distances and projections on plain double columns; there is no geometry type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius of the great-circle formula (km), of the planar ones (m), metres a degree.
EARTH_KM = 6371.0088
EARTH_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
KM_PER_DEGREE_LON, KM_PER_DEGREE_LAT = 111.32, 110.574


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def js_round(x: Column) -> Column:
    """Half goes up, also below zero."""
    return F.floor(x + 0.5)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the squared half chord is kept within [0, 1]."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    h = F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def equirectangular_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar distance at the mean latitude of the two points."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return F.sqrt(x * x + y * y) * EARTH_M


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar distance with fixed kilometres a degree, scaled at the first point."""
    x = (lon2 - lon1) * KM_PER_DEGREE_LON * F.cos(F.radians(lat1))
    y = (lat2 - lat1) * KM_PER_DEGREE_LAT
    return F.sqrt(x * x + y * y)


def segment_projection(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """struct(segment_m, ratio, lateral_m) of a point on a segment, planar at the mean latitude of the three points."""
    scale = EARTH_M * 3.141592653589793 / 180
    xs = F.cos(F.radians((lat1 + lat2 + lat) / 3)) * scale
    ex, ey = (lon2 - lon1) * xs, (lat2 - lat1) * scale
    px, py = (lon - lon1) * xs, (lat - lat1) * scale
    square = ex * ex + ey * ey
    ratio = F.when(square == 0, F.lit(0.0)).otherwise(clamp((px * ex + py * ey) / square, 0.0, 1.0))
    lateral = F.sqrt((px - ratio * ex) * (px - ratio * ex) + (py - ratio * ey) * (py - ratio * ey))
    return F.struct(F.sqrt(square).alias("segment_m"), ratio.alias("ratio"), lateral.alias("lateral_m"))


def expanded_box(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column, margin_m: float) -> Column:
    """struct(south, west, north, east) of a box grown by a margin, within the globe."""
    dlat = margin_m / METRES_PER_DEGREE
    dlon = F.lit(margin_m / METRES_PER_DEGREE) / F.greatest(F.lit(0.1), F.cos(F.radians((min_lat + max_lat) / 2)))
    return F.struct(
        F.greatest(F.lit(-90.0), min_lat - dlat).alias("south"),
        F.greatest(F.lit(-180.0), min_lon - dlon).alias("west"),
        F.least(F.lit(90.0), max_lat + dlat).alias("north"),
        F.least(F.lit(180.0), max_lon + dlon).alias("east"),
    )


def valid_coordinate(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def coordinate_status(distance_m: Column, matched_m: float = 250.0, review_m: float = 1000.0) -> Column:
    """How well a documented place fits the track."""
    return F.when(distance_m <= matched_m, "matched").when(distance_m <= review_m, "needs-review").otherwise("unmatched")


def feature_reach_m(kind: Column) -> Column:
    """How far from the track a feature is kept: localities farther than passes; null for other kinds."""
    return F.when(kind.isin("mountain-pass", "saddle"), 250.0).when(kind.isin("city", "town", "village"), 1500.0)


def leading_number(text: Column) -> Column:
    """The number that a text begins with, blanks between its digits and a decimal comma allowed; null if there is none."""
    plain = F.regexp_replace(F.regexp_replace(text, " ", ""), ",", ".")
    return F.regexp_extract(plain, r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)", 0).try_cast("double")
