"""Stages of a trip: their timing, pauses and their places, order of waypoints, day slots, markers, values between two distances.

Choices that depend on earlier ones (a pause takes a place from the next pause)
are folds over the few pauses of one stage, written as an aggregate over arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.functions.geo import js_round
from trailframe.functions.terrain import break_budget_minutes
from trailframe.operators.terrain import EPSILON, interpolate

# Shares of the way that pauses keep from its ends, from each other, and within which a place is looked for.
EDGE, SPACING, SEARCH = 0.08, 0.08, 0.12
ANCHORS = {"city": 0, "town": 1, "village": 2, "mountain-pass": 3, "saddle": 3}
#: Order of waypoints at one distance. Fixed values.
ORDER = {"start": 0, "end": 0, "mountain-pass": 1, "saddle": 2, "city": 3, "town": 4, "climb": 5, "village": 6, "pause": 7}
#: Minutes between time markers, and the speed that they are counted at. Fixed values.
MARKER_MINUTES, MARKER_KPH = 25.0, 18.0


def ranks(kind: Column, table: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), kind)


def stage_timing(stages: DataFrame, reference_kph: float = 18.0) -> DataFrame:
    """Add break_minutes, moving_s, pause_s, total_s and average_kph to stages(total_km, gain_m, moving_minutes, break_minutes).

    moving_minutes is null where no slope can be told: then the way is flat.  A
    null break is adaptive: it follows from the moving time, which no pause changes.
    """
    flat = F.col("total_km") / reference_kph * 60
    moving = F.when(F.col("moving_minutes").isNull() | ~(F.col("total_km") > 0), flat).otherwise(F.col("moving_minutes"))
    rows = stages.withColumn("_m", moving).withColumn("moving_s", js_round(F.col("_m") * 60).cast("long"))
    pause = F.coalesce(F.col("break_minutes").cast("double"), break_budget_minutes(F.col("total_km"), F.col("moving_s") / 60, F.col("gain_m")))
    rows = rows.withColumn("break_minutes", pause).withColumn("pause_s", js_round(F.col("break_minutes") * 60).cast("long"))
    average = F.when(F.col("_m") > 0, F.col("total_km") / (F.col("_m") / 60))
    return rows.withColumn("total_s", F.col("moving_s") + F.col("pause_s")).withColumn("average_kph", average).drop("_m")


def pause_settings(stages: DataFrame, pauses: DataFrame, trip_mode: Column) -> DataFrame:
    """The custom pauses that hold: stages(stage_id, mode) inherit the trip's mode; pauses are active, at a point, in order."""
    custom = stages.where(F.coalesce("mode", trip_mode) == "custom").select("stage_id")
    rows = pauses.where(F.col("active") & F.col("point_id").isNotNull()).join(custom, "stage_id", "leftsemi")
    w = Window.partitionBy("stage_id").orderBy("order", "pause_id", "point_id", "minutes")
    rows = rows.withColumn("minutes", js_round(F.col("seconds") / 60).cast("int"))
    return rows.select("stage_id", "pause_id", "point_id", "minutes", F.row_number().over(w).alias("position"))


def placing(ideal: str, places: str, total_km: str, position: str, minutes: str, kind: str) -> str:
    """SQL: pauses (position, km, minutes, waypoint_id) from arrays of ideal ones (position, km, minutes) and of places (p, km, id); then the types of the fields."""
    free = (
        f"filter(coalesce({places}, array()), w -> w.km >= {total_km} * {EDGE}D and w.km <= {total_km} - {total_km} * {EDGE}D and abs(w.km - i.km) <= {total_km} * {SEARCH}D "
        f"and forall(acc, q -> abs(q.km - w.km) >= {total_km} * {SPACING}D and not (q.waypoint_id <=> w.id)))"
    )
    best = f"array_min(transform({free}, w -> named_struct('p', w.p, 'far', abs(w.km - i.km), 'id', w.id, 'km', w.km)))"
    inside = f"least(greatest(i.km, {total_km} * {EDGE}D), {total_km} - {total_km} * {EDGE}D)"
    one = f"transform(array({best}), b -> named_struct('position', i.position, 'km', coalesce(b.km, {inside}), 'minutes', i.minutes, 'waypoint_id', b.id))"
    return f"aggregate({ideal}, cast(array() as array<struct<position:{position},km:double,minutes:{minutes},waypoint_id:{kind}>>), (acc, i) -> concat(acc, {one}))"


def placed_pauses(ideal: DataFrame, waypoints: DataFrame, totals: DataFrame) -> DataFrame:
    """Each ideal pause (route_id, position, km, minutes) at the best waypoint near it, or within the edges where none is.

    waypoints: route_id, waypoint_id, kind, km; totals: route_id, total_km.
    Kinds go before nearness; a pause keeps its distance from those placed before it.
    """
    ranked = waypoints.withColumn("p", ranks(F.col("kind"), ANCHORS)).where("p is not null")
    near = ranked.groupBy("route_id").agg(F.collect_list(F.struct("p", "km", F.col("waypoint_id").alias("id"))).alias("ws"))
    wanted = ideal.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("position", F.col("km").cast("double").alias("km"), "minutes"))).alias("is"))
    rows = wanted.join(totals.where("total_km > 0"), "route_id").join(near, "route_id", "left")
    placed = placing("is", "ws", "total_km", dict(ideal.dtypes)["position"], dict(ideal.dtypes)["minutes"], dict(waypoints.dtypes)["waypoint_id"])
    return rows.select("route_id", F.inline(F.expr(placed)))


def unused_places(targets: DataFrame, places: DataFrame) -> DataFrame:
    """Targets (route_id, position, km) in order take the nearest place (route_id, place_id, km) that no earlier one took; ties to the smaller id."""
    near = places.groupBy("route_id").agg(F.collect_list(F.struct("place_id", "km")).alias("ps"))
    wanted = targets.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("position", "km"))).alias("ts")).join(near, "route_id")
    kind = dict(places.dtypes)["place_id"]
    free = "filter(ps, p -> not exists(acc, q -> q.place_id = p.place_id))"
    best = f"array_min(transform({free}, p -> named_struct('far', abs(p.km - t.km), 'id', p.place_id, 'km', p.km)))"
    one = f"filter(transform(array({best}), b -> named_struct('position', t.position, 'place_id', b.id, 'km', b.km)), b -> b.place_id is not null)"
    taken = f"aggregate(ts, cast(array() as array<struct<position:{dict(targets.dtypes)['position']},place_id:{kind},km:{dict(places.dtypes)['km']}>>), (acc, t) -> concat(acc, {one}))"
    return wanted.select("route_id", F.inline(F.expr(taken)))


def with_placed(waypoints: DataFrame, placed: DataFrame, series: DataFrame) -> DataFrame:
    """Waypoints with pause_minutes of the pauses at them; pauses at no waypoint are waypoints of kind pause at their place of the series."""
    here = placed.where("waypoint_id is not null").select("route_id", "waypoint_id", F.col("minutes").alias("pause_minutes"))
    kept = waypoints.select("route_id", "waypoint_id", "kind", "km", "latitude", "longitude", "elevation_m").join(here, ["route_id", "waypoint_id"], "left")
    alone = placed.where("waypoint_id is null")
    at = interpolate(series, alone.select("route_id", F.col("position").alias("k"), F.col("km").alias("target_km")), ("latitude", "longitude", "elevation_m"))
    made = alone.join(at.select("route_id", F.col("k").alias("position"), "latitude", "longitude", "elevation_m"), ["route_id", "position"])
    made = made.select("route_id", F.lit(None).cast(dict(waypoints.dtypes)["waypoint_id"]).alias("waypoint_id"), F.lit("pause").alias("kind"), "km", "latitude", "longitude", "elevation_m", F.col("minutes").alias("pause_minutes"))
    return in_order(kept.unionByName(made))


def in_order(waypoints: DataFrame) -> DataFrame:
    """Add position: by distance, then by kind, then by id."""
    w = Window.partitionBy("route_id").orderBy("km", ranks(F.col("kind"), ORDER).asc_nulls_last(), "waypoint_id")
    return waypoints.withColumn("position", F.row_number().over(w))


def inserted(slots: Column, after: Column, slot: Column) -> Column:
    """An array of slots with one more behind place `after` (from 0; -1: in front), within the array's bounds."""
    at = F.least(F.greatest(after + 1, F.lit(0)), F.size(slots))
    return F.concat(F.slice(slots, F.lit(1), at), F.array(slot), F.slice(slots, at + 1, F.size(slots) - at))


def removed(slots: Column, place: Column, fixed: str = "ride") -> Column:
    """Without the slot at a place (from 0); null where that slot is a ride, which only its file can remove."""
    there = (place >= 0) & (place < F.size(slots))
    rest = F.concat(F.slice(slots, F.lit(1), place), F.slice(slots, place + 2, F.greatest(F.size(slots) - place - 1, F.lit(0))))
    return F.when(~there, slots).when(F.get(slots, place) != fixed, rest)


def moved(entries: Column, start: Column, by: Column) -> Column:
    """An entry changes places with its neighbour (by: -1 or 1); as it was where there is none."""
    to = start + by
    swapped = F.transform(entries, lambda x, i: F.when(i == start, F.get(entries, to)).when(i == to, F.get(entries, start)).otherwise(x))
    return F.when((start < 0) | (start >= F.size(entries)) | (to < 0) | (to >= F.size(entries)), entries).otherwise(swapped)


def time_markers(series: DataFrame, seeds: DataFrame, minutes: float = MARKER_MINUTES, kph: float = MARKER_KPH) -> DataFrame:
    """Points of a route at every so many minutes of riding, by weighted distance; none where a seed (route_id, weighted_km) stands already.

    series: route_id, weighted_km, distance_km, latitude, longitude, elevation_m.
    """
    step = minutes / 60 * kph
    ends = series.groupBy("route_id").agg(F.max("weighted_km").alias("_end"))
    n = F.ceil(F.col("_end") / step - EPSILON).cast("int") - 1
    asked = ends.where(n >= 1).select("route_id", F.explode(F.sequence(F.lit(1), n)).alias("k")).withColumn("target_km", F.col("k") * F.lit(step))
    taken = seeds.select("route_id", F.round(F.col("weighted_km") / step).cast("int").alias("k"), "weighted_km").where(F.abs(F.col("weighted_km") - F.col("k") * F.lit(step)) <= EPSILON)
    rows = series.select("route_id", F.col("weighted_km").alias("distance_km"), F.col("distance_km").alias("track_km"), "latitude", "longitude", "elevation_m")
    at = interpolate(rows, asked.join(taken, ["route_id", "k"], "left_anti"), ("track_km", "latitude", "longitude", "elevation_m"))
    return at.withColumn("marker", F.row_number().over(Window.partitionBy("route_id").orderBy("k"))).withColumnRenamed("distance_km", "weighted_km").drop("k")


def between(series: DataFrame, spans: DataFrame) -> DataFrame:
    """lowest_m, highest_m and gain_m of a route between two distances: spans(route_id, k, low_km, high_km), values at both ends interpolated.

    The gain up to a distance is linear between samples, so the gain of a span is
    a difference.  Extremes meet in cells a span wide at least.
    """
    known = series.where("elevation_m is not null").select("route_id", "distance_km", "elevation_m")
    w = Window.partitionBy("route_id").orderBy("distance_km")
    rise = F.greatest(F.lit(0.0), F.coalesce(F.col("elevation_m") - F.lag("elevation_m").over(w), F.lit(0.0)))
    climbing = known.withColumn("_up", rise).withColumn("up_m", F.sum("_up").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_up")
    ends = {}
    for side in ("low", "high"):
        asked = spans.select("route_id", "k", F.col(f"{side}_km").alias("target_km"))
        ends[side] = interpolate(climbing, asked, ("elevation_m", "up_m")).select("route_id", "k", F.col("elevation_m").alias(f"{side}_m"), F.col("up_m").alias(f"{side}_up"))
    cell = 0.5
    cells = spans.withColumn("_c", F.explode(F.sequence(F.floor(F.col("low_km") / cell), F.floor(F.col("high_km") / cell))))
    inside = cells.join(known.withColumn("_c", F.floor(F.col("distance_km") / cell)), ["route_id", "_c"]).where("distance_km between low_km and high_km")
    extremes = inside.groupBy("route_id", "k").agg(F.min("elevation_m").alias("_min"), F.max("elevation_m").alias("_max"))
    rows = ends["low"].join(ends["high"], ["route_id", "k"]).join(extremes, ["route_id", "k"], "left")
    return rows.select("route_id", "k", F.least("low_m", "high_m", "_min").alias("lowest_m"), F.greatest("low_m", "high_m", "_max").alias("highest_m"), (F.col("high_up") - F.col("low_up")).alias("gain_m"))


def positions_at(timed: DataFrame, pauses: DataFrame, asked: DataFrame, totals: DataFrame) -> DataFrame:
    """Where a rider is by plan: asked(route_id, k, elapsed) minutes after the start -> distance, place, height, climb and descent so far, paused.

    timed: route_id, moving_minutes, distance_km, latitude, longitude, elevation_m;
    pauses: route_id, start_minutes, end_minutes (of elapsed time, apart from each
    other); totals: route_id, total_minutes, gain_m, loss_m.  Within a pause the time
    stands still.  Climb and descent of the profile are scaled to the route's totals.
    """
    w = Window.partitionBy("route_id").orderBy("moving_minutes", "distance_km")
    change = F.coalesce(F.col("elevation_m") - F.lag("elevation_m").over(w), F.lit(0.0))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("route_id")
    rows = timed.withColumn("_d", change).withColumn("_up", F.sum(F.greatest("_d", F.lit(0.0))).over(running)).withColumn("_down", F.sum(F.greatest(-F.col("_d"), F.lit(0.0))).over(running))
    rows = rows.join(totals.select("route_id", "gain_m", "loss_m"), "route_id")
    for part, total in (("_up", "gain_m"), ("_down", "loss_m")):
        end = F.max(part).over(whole)
        rows = rows.withColumn(total, F.when(end > EPSILON, F.col(part) * F.col(total) / end).otherwise(F.lit(0.0)))
    series = rows.select("route_id", F.col("moving_minutes").alias("distance_km"), F.col("distance_km").alias("track_km"), "latitude", "longitude", "elevation_m", "gain_m", "loss_m")

    few = pauses.groupBy("route_id").agg(F.collect_list(F.struct("start_minutes", "end_minutes")).alias("_ps"))
    at = asked.join(totals.select("route_id", "total_minutes"), "route_id").join(few, "route_id", "left")
    at = at.withColumn("_e", F.least(F.greatest(F.col("elapsed"), F.lit(0.0)), F.col("total_minutes"))).withColumn("_ps", F.coalesce("_ps", F.expr("array()")))
    at = at.withColumn("_now", F.expr("get(filter(_ps, p -> _e between p.start_minutes and p.end_minutes), 0).start_minutes"))
    still = F.coalesce("_now", "_e")
    at = at.withColumn("_t", still)
    gone = F.expr("aggregate(filter(_ps, p -> p.end_minutes <= _t), 0D, (acc, p) -> acc + p.end_minutes - p.start_minutes)")
    moving = at.select("route_id", "k", F.col("_now").isNotNull().alias("paused"), (F.col("_t") - gone).alias("target_km"))
    values = interpolate(series, moving, ("track_km", "latitude", "longitude", "elevation_m", "gain_m", "loss_m"))
    return values.drop("distance_km").join(moving.select("route_id", "k", "paused"), ["route_id", "k"])


def downsampled(profile: DataFrame, most: int) -> DataFrame:
    """At most so many points of a route's profile (route_id, k, elevation_m): of each bucket the one that differs most from the one picked before."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("k")
        if len(ordered) <= most:
            return ordered
        e = ordered["elevation_m"].to_numpy(float)
        width, kept = (len(e) - 2) / (most - 2), [0]
        for bucket in range(most - 2):
            start = int(1 + bucket * width)
            end = max(start + 1, int(1 + (bucket + 1) * width))
            kept.append(start + int(np.abs(e[start:end] - e[kept[-1]]).argmax()))
        return ordered.iloc[[*kept, len(e) - 1]]

    return profile.groupBy("route_id").applyInPandas(pick, profile.schema)


def route_fingerprints(points: DataFrame, hashes: DataFrame) -> DataFrame:
    """route_id, fingerprint: sha256:<hash> of the route's file if known (route_id, sha256), else its id and rounded coordinates in order."""
    place = F.struct("seq", F.format_string("%.6f,%.6f", "latitude", "longitude").alias("p"))
    key = F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["p"]), ";")
    shapes = points.groupBy("route_id").agg(F.when(F.count("*") >= 2, key).otherwise("no-geometry").alias("_key")).join(hashes, "route_id", "left")
    whole = F.when(F.col("sha256").isNotNull(), F.concat(F.lit("sha256:"), "sha256")).otherwise(F.concat(F.lit("route:"), F.col("route_id").cast("string"), F.lit(":"), "_key"))
    return shapes.select("route_id", whole.alias("fingerprint"))


def point_role(resolution: Column, reference: Column) -> Column:
    """Role of a documented point: weather-reference (on a given list), route-point (matched) or information."""
    return F.when(reference, "weather-reference").when(resolution == "matched", "route-point").otherwise("information")


def counts_for_risk(role: Column, planned: Column) -> Column:
    """Whether a point's weather counts for its day: points of the route, and references that are planned for."""
    return (role == "route-point") | ((role == "weather-reference") & F.coalesce(planned, F.lit(False)))
