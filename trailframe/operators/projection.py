"""Documented points on tracks: projection, replay of approved placements with a drift check, links to waypoints.

Tracks are vertices of (route_id, segment_index, point_index, latitude, longitude,
elevation_m); a segment's index counts its own points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.functions.geo import EARTH_KM, clamp, coordinate_status, haversine_km

EPSILON = 1e-9
#: How far a replayed placement may be from the approved one (metres, kilometres along the track, metres of height, metres to its anchor, share of the segment).
MOVED_M, ALONG_KM, HEIGHT_M, ANCHOR_M, SHARE = 15.0, 0.015, 5.0, 15.0, 0.02
#: Along the track, how far a waypoint may be from a point that is linked to it: passes and summits, others.
SUMMIT_LINK_KM, LINK_KM = 0.5, 0.75


def vertices(points: DataFrame) -> DataFrame:
    """Add track_km along the route; gaps between segments count for nothing."""
    own = Window.partitionBy("route_id", "segment_index").orderBy("point_index")
    step = haversine_km(F.lag("latitude").over(own), F.lag("longitude").over(own), F.col("latitude"), F.col("longitude"))
    along = Window.partitionBy("route_id").orderBy("segment_index", "point_index").rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("track_km", F.sum("_step").over(along)).drop("_step")


def known(a: Column, b: Column, share: Column) -> Column:
    """Between two values by share; where one is missing, the other one."""
    return F.coalesce(a + (b - a) * share, a, b)


def placed(a: str, b: str, share: Column) -> list[Column]:
    """The place between two vertices (structs) by share."""
    at = lambda c: F.col(f"{a}.{c}") + (F.col(f"{b}.{c}") - F.col(f"{a}.{c}")) * share
    along = F.col(f"{a}.track_km") + F.greatest(F.lit(0.0), F.col(f"{b}.track_km") - F.col(f"{a}.track_km")) * share
    height = known(F.col(f"{a}.elevation_m"), F.col(f"{b}.elevation_m"), share)
    return [at("latitude").alias("track_latitude"), at("longitude").alias("track_longitude"), height.alias("track_elevation_m"), along.alias("track_km")]


def edges(track: DataFrame) -> DataFrame:
    """Pairs (a, b) of neighbouring vertices of a segment; a segment of one vertex is a pair with itself."""
    own = Window.partitionBy("route_id", "segment_index").orderBy("point_index")
    v = F.struct("segment_index", "point_index", "latitude", "longitude", "elevation_m", "track_km")
    pairs = track.select("route_id", v.alias("a"), F.coalesce(F.lead(v).over(own), F.when(F.lag(v).over(own).isNull(), v)).alias("b"))
    return pairs.where("b is not null")


def projected(points: DataFrame, track: DataFrame, on_globe: bool = True) -> DataFrame:
    """Points (route_id, point_id, latitude, longitude) on their route: place, segment, vertices, share, track_km, distance_m and status.

    The nearest edge counts, in the point's own plane; an edge further on must be
    nearer by more than an epsilon.  What that keeps depends on the order of edges,
    so it is a fold, but only edges nearer than all before can be kept: a window
    leaves these few, and the fold runs over them.  Points off the globe are left
    out, but for tracks on a continued grid (on_globe=False).
    """
    rad = F.radians
    x = lambda v: rad(F.col(f"{v}.longitude") - F.col("longitude")) * F.cos(rad("latitude")) * EARTH_KM
    y = lambda v: rad(F.col(f"{v}.latitude") - F.col("latitude")) * EARTH_KM
    dx, dy = x("b") - x("a"), y("b") - y("a")
    square = dx * dx + dy * dy
    share = F.when(square <= EPSILON, F.lit(0.0)).otherwise(clamp(-(x("a") * dx + y("a") * dy) / square, 0.0, 1.0))
    known_ = points.where("latitude between -90 and 90 and longitude between -180 and 180") if on_globe else points.where("latitude is not null and longitude is not null")
    asked = known_.select("route_id", "point_id", "latitude", "longitude")
    near = asked.join(edges(track), "route_id").withColumn("share", share)
    near = near.select("route_id", "point_id", "latitude", "longitude", "share", F.col("a.segment_index").alias("segment_index"), F.col("a.point_index").alias("point_index"),
        F.col("b.point_index").alias("next_point_index"), *placed("a", "b", F.col("share")))
    near = near.withColumn("distance_m", haversine_km(F.col("latitude"), F.col("longitude"), F.col("track_latitude"), F.col("track_longitude")) * 1000)
    before = Window.partitionBy("route_id", "point_id").orderBy("segment_index", "point_index").rowsBetween(Window.unboundedPreceding, -1)
    records = near.withColumn("_least", F.min("distance_m").over(before)).where("_least is null or distance_m < _least").drop("_least", "latitude", "longitude")
    fields = [c for c in records.columns if c not in ("route_id", "point_id")]
    rows = F.array_sort(F.collect_list(F.struct("segment_index", "point_index", *(c for c in fields if c not in ("segment_index", "point_index")))))
    kept = F.expr(f"aggregate(slice(rows, 2, size(rows)), rows[0], (s, e) -> if(e.distance_m < s.distance_m - {EPSILON}, e, s))")
    best = records.groupBy("route_id", "point_id").agg(rows.alias("rows")).select("route_id", "point_id", kept.alias("p"))
    return best.select("route_id", "point_id", *(F.col(f"p.{c}").alias(c) for c in fields), coordinate_status(F.col("p.distance_m")).alias("status"))


def replayed(overrides: DataFrame, track: DataFrame) -> DataFrame:
    """Approved placements laid on the current track: kept, drifted (with the tolerances that failed) or lost.

    overrides: route_id, point_id, version, segment_index, point_index,
    next_point_index, share, latitude, longitude, elevation_m, approved_km,
    anchor_latitude, anchor_longitude, anchor_m.  Of several versions of a placement
    the newest counts.  It is lost where its vertices are gone or aren't neighbours
    any more; a drifted one isn't applied either, so only kept rows have a place.
    """
    newest = F.row_number().over(Window.partitionBy("route_id", "point_id").orderBy(F.desc("version")))
    last = overrides.withColumn("_n", newest).where("_n = 1").drop("_n").withColumnsRenamed({"latitude": "_lat", "longitude": "_lon", "elevation_m": "_up"})
    v = F.struct("point_index", "latitude", "longitude", "elevation_m", "track_km")
    at = track.select(F.col("route_id").alias("_r"), F.col("segment_index").alias("_s"), F.col("point_index").alias("_p"), v.alias("a"))
    to = at.select(F.col("_r").alias("_r2"), F.col("_s").alias("_s2"), F.col("_p").alias("_p2"), F.col("a").alias("_b"))
    met = last.join(at, (F.col("route_id") == F.col("_r")) & (F.col("segment_index") == F.col("_s")) & (F.col("point_index") == F.col("_p")), "left")
    met = met.join(to, (F.col("route_id") == F.col("_r2")) & (F.col("segment_index") == F.col("_s2")) & (F.col("next_point_index") == F.col("_p2")), "left")
    still = (F.col("next_point_index") == F.col("point_index")) & (F.col("share") <= EPSILON)
    share = F.when(still, F.lit(0.0)).otherwise(F.col("share"))
    whole = F.col("a").isNotNull() & (still | (F.col("_b").isNotNull() & (F.col("next_point_index") == F.col("point_index") + 1) & F.col("share").between(0, 1)))
    met = met.withColumn("b", F.when(still, F.col("a")).otherwise(F.col("_b"))).withColumn("_whole", F.coalesce(whole, F.lit(False))).withColumn("_share", share)
    met = met.select("route_id", "point_id", "version", "approved_km", "anchor_latitude", "anchor_longitude", "anchor_m", "share", "_lat", "_lon", "_up", "_whole", "_share", *placed("a", "b", F.col("_share")))
    here = (F.col("track_latitude"), F.col("track_longitude"))
    met = met.withColumns({
        "moved_m": haversine_km(F.col("_lat"), F.col("_lon"), *here) * 1000, "along_km": F.abs(F.col("track_km") - F.col("approved_km")),
        "height_m": F.abs(F.col("track_elevation_m") - F.col("_up")), "distance_m": haversine_km(F.col("anchor_latitude"), F.col("anchor_longitude"), *here) * 1000,
    })
    failed = F.array_compact(F.array(
        F.when(F.col("moved_m") > MOVED_M, "coordinates"), F.when(F.col("along_km") > ALONG_KM, "track-distance"),
        F.when(F.coalesce(F.col("height_m") > HEIGHT_M, F.lit(True)), "elevation"), F.when(F.abs(F.col("distance_m") - F.col("anchor_m")) > ANCHOR_M, "anchor-distance"),
        F.when(F.abs(F.col("_share") - F.col("share")) > SHARE, "segment-share"),
    ))
    met = met.withColumn("failed", F.when(F.col("_whole"), F.array_join(failed, ",")).otherwise(F.lit("")))
    state = F.when(~F.col("_whole"), "lost").when(F.col("failed") != "", "drifted").otherwise("kept")
    kept = lambda c: F.when(F.col("state") == "kept", F.col(c)).alias(c)
    places = ("track_latitude", "track_longitude", "track_elevation_m", "track_km", "distance_m")
    return met.withColumn("state", state).select("route_id", "point_id", "version", "state", "failed", *(kept(c) for c in places))


def link_reach(kind: Column) -> Column:
    return F.when(kind.isin("col", "summit"), F.lit(SUMMIT_LINK_KM)).otherwise(F.lit(LINK_KM))


def linked(points: DataFrame, waypoints: DataFrame) -> DataFrame:
    """Add waypoint_id and apart_km to matched points: the nearest waypoint along the track within the reach of their kind, the earlier one at ties.

    points: day_id, point_id, name, kind, status, track_km, overridden, waypoint_id (set for ends).
    waypoints: day_id, waypoint_id, ordinal, km.  Waypoints lie in cells as long as
    the reach and are met from three of them, so it is an equi-join.
    """
    cell = lambda c: F.floor(F.col(c) / LINK_KM)
    live = points.where("status = 'matched' and track_km is not null and waypoint_id is null")
    asked = live.select("day_id", "point_id", "kind", "track_km", F.explode(F.sequence(cell("track_km") - 1, cell("track_km") + 1)).alias("_cell"))
    w = waypoints.select("day_id", F.col("waypoint_id").alias("_w"), "ordinal", F.col("km").alias("_km"), cell("km").alias("_cell"))
    far = F.abs(F.col("_km") - F.col("track_km"))
    # the nearest of all within the longest reach is the nearest of all; its own kind's reach is asked afterwards
    near = asked.join(w, ["day_id", "_cell"]).groupBy("day_id", "point_id", "kind").agg(F.min(F.struct(far.alias("far"), "ordinal", "_w")).alias("b"))
    found = near.where(F.col("b.far") <= link_reach(F.col("kind")) + EPSILON).select("day_id", "point_id", F.col("b._w").alias("_w"))
    joined = points.join(found, ["day_id", "point_id"], "left").withColumn("waypoint_id", F.coalesce("waypoint_id", "_w")).drop("_w")
    ends = waypoints.select("day_id", "waypoint_id", F.col("km").alias("_km"))
    return joined.join(ends, ["day_id", "waypoint_id"], "left").withColumn("apart_km", F.coalesce(F.abs(F.col("_km") - F.col("track_km")), F.when(F.col("_km").isNotNull(), 0.0))).drop("_km")


def link_priority(kind: Column, overridden: Column) -> Column:
    return F.when(kind.isin("start", "end"), 0).when(overridden, 1).otherwise(2)


def link_groups(points: DataFrame) -> DataFrame:
    """One row a waypoint with the points linked to it (see linked): ids by priority, the first one's name, the largest distance."""
    rows = points.where("waypoint_id is not null")
    order = F.array_sort(F.collect_list(F.struct(link_priority(F.col("kind"), F.col("overridden")).alias("p"), "apart_km", "point_id", "name")))
    groups = rows.groupBy("day_id", "waypoint_id").agg(order.alias("g"), F.max("apart_km").alias("max_km"))
    return groups.select("day_id", "waypoint_id", F.array_join(F.transform("g", lambda x: x["point_id"].cast("string")), ",").alias("point_ids"),
        F.col("g")[0]["point_id"].alias("primary_id"), F.col("g")[0]["name"].alias("name"), "max_km")


def standalone_groups(points: DataFrame) -> DataFrame:
    """Matched points without a waypoint become waypoints of their own; near ones are one: day_id, primary_id, point_ids, track_km (of the primary).

    In order along the track a point joins the first group that has a member within
    the shorter reach of both.  Points of a day that lie apart by more than any reach
    are folded apart, so a fold sees a stretch of track, not a day.
    """
    live = points.where("status = 'matched' and waypoint_id is null and track_km is not null")
    w = Window.partitionBy("day_id").orderBy("track_km", "point_id")
    begins = F.coalesce(F.col("track_km") - F.lag("track_km").over(w) > LINK_KM + EPSILON, F.lit(False)).cast("int")
    cut = live.withColumn("_new", begins).withColumn("_island", F.sum("_new").over(w))
    row = F.struct("track_km", "point_id", link_reach(F.col("kind")).alias("reach"), link_priority(F.col("kind"), F.col("overridden")).alias("p"))
    folded = F.expr(
        "aggregate(rows, cast(array() as array<array<struct<track_km:double,point_id:bigint,reach:double,p:int>>>), (gs, r) -> transform(array(array_position("
        f"transform(gs, g -> exists(g, c -> abs(c.track_km - r.track_km) <= least(c.reach, r.reach) + {EPSILON})), true)), "
        "k -> if(k = 0, concat(gs, array(array(r))), transform(gs, (g, i) -> if(i + 1 = k, concat(g, array(r)), g))))[0])"
    )
    groups = cut.groupBy("day_id", "_island").agg(F.array_sort(F.collect_list(row)).alias("rows")).select("day_id", F.explode(folded).alias("g"))
    first = F.array_min(F.transform("g", lambda x: F.struct(x["p"].alias("p"), x["point_id"].alias("point_id"), x["track_km"].alias("track_km"))))
    return groups.select("day_id", first["point_id"].alias("primary_id"), F.array_join(F.transform("g", lambda x: x["point_id"].cast("string")), ",").alias("point_ids"), first["track_km"].alias("track_km"))


#: Difference of height up to which a summit may be a documented pass, and up to which it is a good one (metres); least distance between summits (km).
HEIGHT_WITHIN_M, HEIGHT_GOOD_M, APART_KM = 200.0, 100.0, 2.0


def free_summits(points: DataFrame, summits: DataFrame, apart_km: float = APART_KM) -> DataFrame:
    """Summits (day_id, summit_id, km, elevation_m) that a documented pass may be: far enough from the one before, and from points that are matched already."""
    w = Window.partitionBy("day_id").orderBy("km", "summit_id")
    spaced = summits.where("elevation_m is not null").withColumn("_gap", F.col("km") - F.lag("km").over(w)).where(F.col("_gap").isNull() | (F.col("_gap") >= apart_km - EPSILON)).drop("_gap")
    cell = lambda c: F.floor(F.col(c) / apart_km)
    fixed = points.where("fixed_km is not null").select("day_id", F.col("fixed_km").alias("_f"), F.explode(F.sequence(cell("fixed_km") - 1, cell("fixed_km") + 1)).alias("_c"))
    near = spaced.withColumn("_c", cell("km")).join(fixed, ["day_id", "_c"]).where(F.abs(F.col("km") - F.col("_f")) < apart_km - EPSILON).select("day_id", "summit_id").distinct()
    return spaced.join(near, ["day_id", "summit_id"], "left_anti")


def profile_matches(points: DataFrame, summits: DataFrame, within_m: float = HEIGHT_WITHIN_M, good_m: float = HEIGHT_GOOD_M, apart_km: float = APART_KM) -> DataFrame:
    """Documented passes on detected summits, in order: day_id, point_id, summit_id, km, height_m (the difference).

    points: day_id, point_id, ordinal, elevation_m, fixed_km (where the point is
    matched otherwise; such points keep their place and aren't matched here).  The
    assignment with the most matches wins, then that with the most good ones, then
    that with the smallest sum of differences.  A summit between two fixed points
    goes only to a pass between them.  It is a dynamic program over the few passes
    and summits of one day.
    """
    a = points.select("day_id", F.lit(0).alias("side"), "point_id", F.col("ordinal").cast("double").alias("at"), F.col("elevation_m").cast("double").alias("e"), F.col("fixed_km").cast("double").alias("fixed"))
    b = free_summits(points, summits, apart_km).select("day_id", F.lit(1), F.col("summit_id"), F.col("km").cast("double"), F.col("elevation_m").cast("double"), F.lit(None).cast("double"))

    def matched(side: np.ndarray, point_id: np.ndarray, at: np.ndarray, e: np.ndarray, fixed: np.ndarray) -> list[tuple]:
        k = int((side == 0).sum())
        low, high, last, nxt = [0.0] * k, [0.0] * k, -np.inf, np.inf
        for i in range(k):
            low[i] = last
            last = fixed[i] + apart_km - EPSILON if fixed[i] == fixed[i] else last
        for i in range(k - 1, -1, -1):
            high[i] = nxt
            nxt = fixed[i] - apart_km + EPSILON if fixed[i] == fixed[i] else nxt
        open_ = [i for i in range(k) if fixed[i] != fixed[i] and e[i] == e[i]]
        x, y, km = e[open_].tolist(), e[k:].tolist(), at[k:].tolist()
        n, m = len(x), len(y)
        best = [[(0, 0, 0.0)] * (m + 1) for _ in range(n + 1)]
        taken = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                most, pick = best[i + 1][j], 0  # the first of equals stays
                if best[i][j + 1] > most:
                    most, pick = best[i][j + 1], 1
                error = abs(x[i] - y[j])
                if error <= within_m and low[open_[i]] <= km[j] <= high[open_[i]]:
                    count, good, less = best[i + 1][j + 1]
                    met = (count + 1, good + (error <= good_m), less - error)
                    if met > most:
                        most, pick = met, 2
                best[i][j], taken[i][j] = most, pick
        i = j = 0
        out = []
        while i < n and j < m:
            if taken[i][j] == 2:
                out.append((point_id[open_[i]], point_id[k + j], km[j], abs(x[i] - y[j])))
            i, j = i + (taken[i][j] != 1), j + (taken[i][j] != 0)
        return out

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A batch holds many days, so the cost of a frame is not paid by the day."""
        for days in batches:
            numbers = [[np.asarray(x, float) for x in days[c]] for c in ("at", "e", "fixed")]
            rows = [(day, *m) for day, *of in zip(days.day_id, days.side, days.point_id, *numbers, strict=True) for m in matched(*of)]
            yield pd.DataFrame(rows, columns=["day_id", "point_id", "summit_id", "km", "height_m"])

    row = F.struct("side", F.coalesce(F.isnan("at"), F.lit(True)).alias("last"), "at", "point_id", "e", "fixed")
    days = a.union(b).groupBy("day_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    return days.select("day_id", *[F.col(f"_rows.{c}").alias(c) for c in ("side", "point_id", "at", "e", "fixed")]).mapInPandas(fold, "day_id long, point_id long, summit_id long, km double, height_m double")


def alternatives(points: DataFrame, summits: DataFrame, matches: DataFrame, within_m: float = HEIGHT_WITHIN_M, good_m: float = HEIGHT_GOOD_M) -> DataFrame:
    """Other summits of the day that a documented pass may be, best first: day_id, point_id, summit_id, good, height_m, rank."""
    asked = points.where("elevation_m is not null").select("day_id", "point_id", F.col("elevation_m").alias("_e"))
    near = asked.join(summits.where("elevation_m is not null"), "day_id").withColumn("height_m", F.abs(F.col("elevation_m") - F.col("_e"))).where(F.col("height_m") <= within_m)
    rest = near.join(matches.select("day_id", "point_id", "summit_id"), ["day_id", "point_id", "summit_id"], "left_anti").withColumn("good", F.col("height_m") <= good_m)
    rank = F.row_number().over(Window.partitionBy("day_id", "point_id").orderBy(F.desc("good"), "height_m", "km", "summit_id"))
    return rest.withColumn("rank", rank).select("day_id", "point_id", "summit_id", "good", "height_m", "rank")
