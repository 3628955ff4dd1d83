"""The timeline of a route over several files: seeds, markers, pauses and ends merged in order of time, and what must hold of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-9
#: What comes first at one time and place, and how far a feature stays from the ends of its file (km).
ORDER = {
    "route-start": 0, "gpx-end": 1, "gpx-start": 2, "summit": 3, "valley": 3, "slope-change": 3, "time-marker": 3, "pause-start": 4, "pause-end": 5, "route-end": 6,
}
FEATURE_SPACING_KM = 2.0
WAYPOINT = ("route_id", "file_number", "waypoint_id", "kind", "name", "km", "weighted_km", "moving_minutes")


def place_of(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair]), kind)


def seeds(files: DataFrame, features: DataFrame, least_km: float = FEATURE_SPACING_KM) -> DataFrame:
    """Waypoints at the ends of each file and at its features, but for features near an end.

    files: route_id, file_number, start_name, end_name, and start and end, structs of (km, weighted_km, moving_minutes).
    features: route_id, file_number, kind, km, weighted_km, moving_minutes.  Features are
    numbered along the whole route, those left out not counted.
    """
    w = Window.partitionBy("route_id").orderBy("file_number")
    ranked = files.withColumn("_first", F.row_number().over(w) == 1).withColumn("_last", F.lead("file_number").over(w).isNull())

    def end(edge: str, side: str) -> Column:
        kind = F.when(F.col(edge), f"route-{side}").otherwise(f"gpx-{side}")
        return F.struct(F.concat(kind, F.lit("-"), F.col("file_number").cast("string")).alias("waypoint_id"), kind.alias("kind"), F.col(f"{side}_name").alias("name"), F.col(f"{side}.km").alias("km"),
            F.col(f"{side}.weighted_km").alias("weighted_km"), F.col(f"{side}.moving_minutes").alias("moving_minutes"))

    ends = ranked.select("route_id", "file_number", F.inline(F.array(end("_first", "start"), end("_last", "end"))))
    inside = features.join(files.select("route_id", "file_number", F.col("start.km").alias("_from"), F.col("end.km").alias("_to")), ["route_id", "file_number"])
    inside = inside.where((F.col("km") - F.col("_from") >= least_km) & (F.col("_to") - F.col("km") >= least_km))
    n = F.row_number().over(Window.partitionBy("route_id").orderBy("file_number", "km", "kind")).cast("string")
    named = inside.withColumn("_n", n).withColumn("waypoint_id", F.concat_ws("-", "kind", F.col("file_number").cast("string"), "_n")).withColumn("name", F.concat_ws(" ", "kind", "_n"))
    return ends.select(*WAYPOINT).union(named.select(*WAYPOINT))


def with_markers(seeds_: DataFrame, markers: DataFrame, apart_km: float = 0.0) -> DataFrame:
    """Seeds, and those markers (route_id, file_number, km, weighted_km, moving_minutes) that no seed is near to, by weighted distance; numbered in order.

    A marker looks for seeds in its own cell of that width and in its neighbours.
    """
    size = max(apart_km, 1e-6)
    cell = lambda c: F.floor(F.col(c) / size)
    asked = markers.withColumn("_cell", F.explode(F.sequence(cell("weighted_km") - 1, cell("weighted_km") + 1)))
    taken = seeds_.select("route_id", F.col("weighted_km").alias("_seed"), cell("weighted_km").alias("_cell"))
    near = asked.join(taken, ["route_id", "_cell"]).where(F.abs(F.col("_seed") - F.col("weighted_km")) <= apart_km + EPSILON).select("route_id", "file_number", "weighted_km").distinct()
    free = markers.join(near, ["route_id", "file_number", "weighted_km"], "left_anti")
    n = F.row_number().over(Window.partitionBy("route_id").orderBy("weighted_km")).cast("string")
    named = free.withColumn("_n", n).withColumn("kind", F.lit("time-marker")).withColumn("waypoint_id", F.concat(F.lit("time-marker-"), "_n")).withColumn("name", F.concat(F.lit("marker "), "_n"))
    return seeds_.select(*WAYPOINT).union(named.select(*WAYPOINT))


def scheduled(pauses: DataFrame) -> DataFrame:
    """Pauses (route_id, pause_id, name, km, minutes, moving_minutes) along the track with start_minutes and end_minutes; those of no length are none."""
    w = Window.partitionBy("route_id").orderBy("km", "pause_id").rowsBetween(Window.unboundedPreceding, -1)
    before = pauses.withColumn("_before", F.coalesce(F.sum("minutes").over(w), F.lit(0))).where("minutes > 0")
    start = F.col("moving_minutes") + F.col("_before")
    return before.withColumn("start_minutes", start).withColumn("end_minutes", start + F.col("minutes")).drop("_before")


def assembled(waypoints: DataFrame, pauses: DataFrame, departures: DataFrame) -> DataFrame:
    """The timeline: waypoints and both ends of each pause in order, with position, elapsed_minutes and clock_minutes.

    A waypoint is as late as its riding time and all pauses before it; at one time and
    place the kind decides, then the id.  Pauses and waypoints of a route are merged
    in one sort, and a running sum says what has been paused.
    departures: route_id, departure_minutes.
    """
    stops = scheduled(pauses)
    rows = waypoints.select(*WAYPOINT, F.col("km").alias("_at"), F.lit(0.0).alias("_pause"))
    marks = stops.select("route_id", (F.col("km") + EPSILON).alias("_at"), F.col("minutes").cast("double").alias("_pause"))
    w = Window.partitionBy("route_id").orderBy("_at", F.desc("_pause"), "waypoint_id").rowsBetween(Window.unboundedPreceding, 0)
    merged = rows.unionByName(marks, allowMissingColumns=True).withColumn("_paused", F.sum("_pause").over(w)).where("waypoint_id is not null")
    timed = merged.select(*WAYPOINT[:6], (F.col("moving_minutes") + F.col("_paused")).alias("elapsed_minutes"))
    ends = F.array(*(
        F.struct(F.concat(F.lit("pause-"), F.col("pause_id").cast("string"), F.lit(f"-{side}")).alias("waypoint_id"), F.lit(f"pause-{side}").alias("kind"), F.col(f"{side}_minutes").alias("elapsed_minutes"))
        for side in ("start", "end")
    ))
    paused = stops.select("route_id", F.lit(None).cast(dict(waypoints.dtypes)["file_number"]).alias("file_number"), "name", "km", F.inline(ends))
    every = timed.unionByName(paused).join(departures, "route_id")
    order = Window.partitionBy("route_id").orderBy("elapsed_minutes", "km", place_of(F.col("kind")), "waypoint_id")
    return every.withColumn("position", F.row_number().over(order)).withColumn("clock_minutes", F.col("departure_minutes") + F.col("elapsed_minutes")).drop("departure_minutes")


def timeline_issues(timeline: DataFrame, totals: DataFrame) -> DataFrame:
    """What doesn't hold of timelines: route_id, waypoint_id (null for the whole), code.

    totals: route_id, files, break_minutes, moving_minutes, total_minutes.  Rules: ids
    stand once; time and distance don't fall along the positions; numbers are
    finite; pauses add up to the break, and break and riding to the whole; the first
    and last waypoints are the route's ends; all files occur, one behind the other.
    """
    w, ids = Window.partitionBy("route_id").orderBy("position"), Window.partitionBy("route_id", "waypoint_id")
    back = lambda c: F.col(c) + EPSILON < F.lag(c).over(w)
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = timeline.withColumns({
        "_again": F.row_number().over(ids.orderBy("position")) > 1, "_back": F.coalesce(back("elapsed_minutes") | back("km"), F.lit(False)), "_odd": odd("km") | odd("elapsed_minutes") | odd("clock_minutes"),
    })
    codes = F.array_compact(F.array(F.when(F.col("_again"), "duplicate-id"), F.when(F.col("_back"), "not-ordered"), F.when(F.col("_odd"), "not-finite")))
    # what is wrong with single waypoints comes along with what is told of the whole: the timeline is worked out once
    single = F.flatten(F.collect_list(F.transform(codes, lambda code: F.struct("waypoint_id", code.alias("code"))))).alias("_single")
    sign = F.when(F.col("kind") == "pause-end", F.col("elapsed_minutes")).when(F.col("kind") == "pause-start", -F.col("elapsed_minutes"))
    spans = F.when(F.col("kind").isin("gpx-start", "route-start"), F.struct("file_number", "km", "elapsed_minutes"))
    waypoint = F.when(~F.col("kind").startswith("pause-"), F.col("position"))  # a pause may stand at an end
    told = rows.groupBy("route_id").agg(
        single,
        F.coalesce(F.sum(sign), F.lit(0.0)).alias("_paused"), F.min_by("kind", waypoint).alias("_first"), F.max_by("kind", waypoint).alias("_last"), F.count_distinct("file_number").alias("_files"),
        F.array_sort(F.collect_list(spans)).alias("_starts"), F.array_sort(F.collect_list(F.when(F.col("kind").isin("gpx-end", "route-end"), F.struct("file_number", "km", "elapsed_minutes")))).alias("_ends"),
    ).join(totals.withColumn("_asked", F.lit(True)), "route_id", "full")
    gap = "exists(sequence(1, size(_starts) - 1), i -> abs(get(_starts, i).km - get(_ends, i - 1).km) > 1e-9 or abs(get(_starts, i).elapsed_minutes - get(_ends, i - 1).elapsed_minutes) > 1e-9)"
    whole = F.array_compact(F.array(
        F.when(~(F.abs(F.col("_paused") - F.col("break_minutes")) <= 1e-6), "pause-sum"), F.when(F.abs(F.col("total_minutes") - F.col("moving_minutes") - F.col("break_minutes")) > EPSILON, "total-mismatch"),
        F.when(~F.col("_files").eqNullSafe(F.col("files")), "files-missing"), F.when(~(F.col("_first").eqNullSafe("route-start") & F.col("_last").eqNullSafe("route-end")), "wrong-ends"),
        F.when((F.size("_starts") > 1) & F.expr(f"size(_starts) > 1 and {gap}"), "files-apart"),
    ))
    of_whole = F.when(F.col("_asked"), F.transform(whole, lambda code: F.struct(F.lit(None).cast("string").alias("waypoint_id"), code.alias("code"))))
    nothing = F.array().cast("array<struct<waypoint_id:string,code:string>>")
    return told.select("route_id", F.inline(F.concat(F.coalesce("_single", nothing), F.coalesce(of_whole, nothing))))
