"""Climbs: pivots of a profile, merging over small dips, significance; tiles of a climb.

Whether a point turns the direction rests on all turns before it, so a route's
profile is folded in order in one grouped function; groups are one route each.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailframe.functions.terrain import CLIMB_PROFILES, grade_class
from trailframe.operators.terrain import interpolate

# Noise of a turn (m), loss (m) and length (km) of a dip that doesn't end a climb.
TURN_M, DIP_M, DIP_KM = 1.0, 25.0, 1.0
CLIMB = "route_id long, number int, start_km double, end_km double, gain_m double, average_grade double, max_grade double, start_m double, end_m double"


def turns(elevation: np.ndarray) -> list[int]:
    """Indices of the first point, every turn, and the last point."""
    out, rising, best = [0], None, 0
    for i in range(1, len(elevation)):
        if rising is None:
            if abs(elevation[i] - elevation[0]) >= TURN_M:
                rising, best = elevation[i] > elevation[0], i
            continue
        ahead = elevation[i] - elevation[best] if rising else elevation[best] - elevation[i]
        if ahead > 0:
            best = i
        elif -ahead >= TURN_M:
            out.append(best)
            rising, best = not rising, i
    if rising is not None:
        out.append(best)
    if out[-1] != len(elevation) - 1:
        out.append(len(elevation) - 1)
    return out


def ascents(elevation: np.ndarray, distance: np.ndarray) -> list[tuple[int, int]]:
    """Valley and peak of each ascent; an ascent goes on over a dip that is small and short."""
    at = turns(elevation)
    if len(at) < 2:
        return []
    valley = 0 if elevation[at[1]] >= elevation[at[0]] else 1  # roles alternate from here
    merged: list[tuple[int, int]] = []
    for low, high in zip(at[valley::2], at[valley + 1 :: 2], strict=False):
        if merged:
            start, peak = merged[-1]
            if elevation[peak] - elevation[low] <= DIP_M and distance[low] - distance[peak] <= DIP_KM:
                merged[-1] = (start, high if elevation[high] > elevation[peak] else peak)
                continue
        merged.append((low, high))
    return merged


def route_climbs(profile: pd.DataFrame) -> pd.DataFrame:
    p = profile.sort_values("k")
    e, d, g = (p[c].to_numpy(float) for c in ("elevation_m", "distance_km", "grade"))
    rows = []
    for low, high in ascents(e, d) if len(p) > 1 else []:
        if high <= low:
            continue
        length, gain = d[high] - d[low], float(np.clip(np.diff(e[low : high + 1]), 0, None).sum())
        average = (e[high] - e[low]) / (length * 1000) * 100 if length > 0 else 0.0
        if any(length >= a and gain >= b and average >= c for a, b, c in CLIMB_PROFILES):
            rows.append((p["route_id"].iloc[0], len(rows) + 1, d[low], d[high], gain, average, g[low : high + 1].max(), e[low], e[high]))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in CLIMB.split(", ")])


def detect(profile: DataFrame) -> DataFrame:
    """profile: route_id, k, distance_km, elevation_m, grade -> significant climbs, numbered along the route."""
    return profile.select("route_id", "k", "distance_km", "elevation_m", "grade").groupBy("route_id").applyInPandas(route_climbs, CLIMB)


def tiles(climbs: DataFrame, tile_km: float = 0.5) -> DataFrame:
    """A climb cut into tiles; the last one is shorter."""
    n = F.ceil((F.col("end_km") - F.col("start_km") - 1e-9) / tile_km).cast("int")
    rows = climbs.where("end_km > start_km").withColumn("tile", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("start_km") + F.col("tile") * F.lit(tile_km)
    return rows.select("route_id", "number", "tile", start.alias("from_km"), F.least(F.col("end_km"), start + tile_km).alias("to_km"))


def tile_profile(climbs: DataFrame, series: DataFrame, tile_km: float = 0.5) -> DataFrame:
    """Tiles with from_m and to_m (interpolated on the route's series), grade and grade_class; null where a height can't be told.

    Climbs shorter than three kilometres are shown in tiles of a quarter of one: pass
    tile_km accordingly.  All ends of tiles meet the series in one sort per route.
    """
    parts = tiles(climbs, tile_km).withColumn("_n", F.row_number().over(Window.partitionBy("route_id").orderBy("number", "tile")))
    ends = parts.select("route_id", F.inline(F.array(F.struct((F.col("_n") * 2).cast("int").alias("k"), F.col("from_km").alias("target_km")), F.struct((F.col("_n") * 2 + 1).cast("int").alias("k"), F.col("to_km").alias("target_km")))))
    at = interpolate(series, ends, ("elevation_m",)).select("route_id", F.floor(F.col("k") / 2).alias("_n"), (F.col("k") % 2).alias("_side"), "elevation_m")
    heights = at.groupBy("route_id", "_n").agg(F.max(F.when(F.col("_side") == 0, F.col("elevation_m"))).alias("from_m"), F.max(F.when(F.col("_side") == 1, F.col("elevation_m"))).alias("to_m"))
    length = F.col("to_km") - F.col("from_km")
    grade = F.when(length > 1e-9, (F.col("to_m") - F.col("from_m")) / (length * 1000) * 100)
    return parts.join(heights, ["route_id", "_n"]).drop("_n").withColumn("grade", grade).withColumn("grade_class", grade_class(F.col("grade")))


def spaced(features: DataFrame, spacing_km: float) -> DataFrame:
    """Best score first; a feature stays if no better one of its route is nearer than the spacing.

    Kept ones stay in order of distance, so that each feature is compared with its two neighbours alone.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(["score", "distance_km"], ascending=[False, True], kind="stable")
        kept: list[int] = []
        taken: list[float] = []
        for i, at in enumerate(ordered["distance_km"].tolist()):
            place = bisect.bisect(taken, at)
            if all(abs(at - other) >= spacing_km for other in taken[max(0, place - 1) : place + 1]):
                kept.append(i)
                taken.insert(place, at)
        return ordered.iloc[kept].sort_values("distance_km")

    return features.groupBy("route_id").applyInPandas(pick, features.schema)
