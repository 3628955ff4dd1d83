"""Measures of ordered tracks: rows of (route_id, seq, latitude, longitude, elevation_m).

Every window is partitioned by route, so routes never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailframe.functions.terrain import slope_band, slope_multiplier
from trailframe.functions.geo import clamp, equirectangular_m, haversine_km, valid_coordinate


def ordered(*keys: str):
    return Window.partitionBy(*keys).orderBy("seq")


def steps(points: DataFrame, *keys: str) -> DataFrame:
    """Add step_km to the point before and the change to the last known elevation (null where there is none)."""
    w = ordered(*keys)
    known = F.last("elevation_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    step = haversine_km(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    return points.withColumn("step_km", F.coalesce(step, F.lit(0.0))).withColumn("step_up_m", F.col("elevation_m") - known)


def cumulative(points: DataFrame, *keys: str) -> DataFrame:
    """Add distance_km (great circle) and distance_m (planar), both from the first point."""
    w = ordered(*keys)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    flat = equirectangular_m(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    stepped = steps(points, *keys).withColumn("_flat", F.coalesce(flat, F.lit(0.0)))
    return stepped.withColumn("distance_km", F.sum("step_km").over(running)).withColumn("distance_m", F.sum("_flat").over(running)).drop("_flat")


def metrics(points: DataFrame, *keys: str) -> DataFrame:
    """One row a track: points, distance, gain and loss (null without a comparison), extremes, altitude coverage."""
    up = F.col("step_up_m")
    return (
        steps(points, *keys)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("points"),
            F.sum("step_km").alias("distance_km"),
            F.sum(F.when(up > 0, up).when(up.isNotNull(), 0.0)).alias("gain_m"),
            F.sum(F.when(up < 0, -up).when(up.isNotNull(), 0.0)).alias("loss_m"),
            F.min("elevation_m").alias("min_m"),
            F.max("elevation_m").alias("max_m"),
            F.count("elevation_m").alias("with_altitude"),
        )
        .withColumn("coverage", F.col("with_altitude") / F.col("points"))
        .withColumn("sufficient", (F.col("coverage") >= 0.5) & (F.col("with_altitude") >= 2))
    )


def summary_by_segment(points: DataFrame) -> DataFrame:
    """A route's totals from the sums of its segments: gaps between segments count for nothing."""
    per = metrics(points, "route_id", "segment_index")
    return per.groupBy("route_id").agg(
        F.count("*").alias("segments"), F.sum("points").alias("points"), F.sum("distance_km").alias("distance_km"), F.sum("gain_m").alias("gain_m"),
        F.sum("loss_m").alias("loss_m"), F.min("min_m").alias("min_m"), F.max("max_m").alias("max_m"),
    )


def segment_gaps(points: DataFrame, least_km: float = 0.1) -> DataFrame:
    """Breaks between one segment's last point and the next one's first."""
    w = Window.partitionBy("route_id").orderBy("segment_index")
    ends = points.groupBy("route_id", "segment_index").agg(
        F.min_by(F.struct("latitude", "longitude"), "seq").alias("a"), F.max_by(F.struct("latitude", "longitude"), "seq").alias("b")
    )
    gap = haversine_km(F.col("before.latitude"), F.col("before.longitude"), F.col("a.latitude"), F.col("a.longitude"))
    return ends.withColumn("before", F.lag("b").over(w)).withColumn("gap_km", gap).where(F.col("gap_km") > least_km).select("route_id", "segment_index", "gap_km")


def first_backward_time(points: DataFrame) -> DataFrame:
    """The first point of a track whose time is before the last known one."""
    known = F.last("ts", ignorenulls=True).over(ordered("route_id").rowsBetween(Window.unboundedPreceding, -1))
    return points.withColumn("_known", known).where(F.col("ts") < F.col("_known")).groupBy("route_id").agg(F.min("seq").alias("seq"))


def bounds(points: DataFrame) -> DataFrame:
    return points.groupBy("route_id").agg(
        F.min("latitude").alias("south"), F.min("longitude").alias("west"), F.max("latitude").alias("north"), F.max("longitude").alias("east")
    )


def invalid_points(points: DataFrame) -> DataFrame:
    """Counts of usable and dropped coordinates."""
    ok = valid_coordinate(F.col("latitude"), F.col("longitude"))
    return points.groupBy("route_id").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


def continuity(points: DataFrame, least_km: float = 1.0) -> DataFrame:
    """Consecutive tracks (by id) whose ends are farther apart than allowed; `chain` keeps trips apart."""
    ends = points.groupBy("chain", "route_id").agg(
        F.min_by(F.struct("latitude", "longitude"), "seq").alias("a"), F.max_by(F.struct("latitude", "longitude"), "seq").alias("b")
    )
    w = Window.partitionBy("chain").orderBy("route_id")
    linked = ends.withColumn("from_id", F.lag("route_id").over(w)).withColumn("p", F.lag("b").over(w)).where("from_id is not null")
    gap = haversine_km(F.col("p.latitude"), F.col("p.longitude"), F.col("a.latitude"), F.col("a.longitude"))
    return linked.select("chain", "from_id", F.col("route_id").alias("to_id"), gap.alias("gap_km"), (gap > least_km).alias("warning"))


def even_sample(points: DataFrame, n: int) -> DataFrame:
    """n points spread evenly by index, the ends included (all, if there are fewer)."""
    size = F.count("*").over(Window.partitionBy("route_id"))
    spread = points.withColumn("_n", size)
    picks = F.expr(f"transform(sequence(0, {n - 1}), k -> cast(floor(k * (_n - 1) / {float(n - 1)} + 0.5) as long))")
    kept = (F.col("_n") <= n) | F.array_contains(picks, F.col("seq").cast("long"))
    return spread.where(kept).drop("_n")


def chunks(points: DataFrame, length_m: float) -> DataFrame:
    """A chunk ends at the first point at which `length_m` is reached and the next one starts there.

    The reset makes it a fold over one route's distances, which keeps nothing but
    the ends of chunks; points then count the ends before them.
    """
    rows = F.array_sort(F.collect_list(F.struct("seq", "distance_m")))
    kind = dict(points.dtypes)["seq"]
    folded = F.expr(
        f"aggregate(rows, named_struct('at', 0D, 'ends', cast(array() as array<{kind}>)), (s, r) -> if(r.distance_m - s.at >= {length_m}, "
        "named_struct('at', r.distance_m, 'ends', concat(s.ends, array(r.seq))), s), s -> s.ends)"
    )
    ends = points.groupBy("route_id").agg(rows.alias("rows")).select("route_id", F.explode(folded).alias("seq"), F.lit(1).alias("_end"))
    before = Window.partitionBy("route_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    marked = points.select("route_id", "seq").join(ends, ["route_id", "seq"], "left")
    return marked.select("route_id", "seq", F.coalesce(F.sum("_end").over(before), F.lit(0)).cast("int").alias("chunk"))


def local_slopes(points: DataFrame, window_km: float = 0.5) -> DataFrame:
    """Slope at raw points over a centred window of known elevations, within 20 percent; 0 where it can't be told."""
    half = window_km / 2
    total = "max(distance_km) OVER (PARTITION BY route_id)"
    frame = f"OVER (PARTITION BY route_id ORDER BY distance_km RANGE BETWEEN {half}D PRECEDING AND {half}D FOLLOWING)"
    known = points.withColumn("_p", F.expr("if(elevation_m is null, null, struct(distance_km as d, elevation_m as e))"))
    ends = known.select("*", F.expr(f"first(_p, true) {frame}").alias("_a"), F.expr(f"last(_p, true) {frame}").alias("_b"), F.expr(total).alias("_t"))
    span = F.col("_b.d") - F.col("_a.d")
    slope = clamp((F.col("_b.e") - F.col("_a.e")) / (span * 1000) * 100, -20.0, 20.0)
    return ends.withColumn("slope", F.when(span >= min(0.05, window_km / 4), slope).otherwise(F.lit(0.0))).drop("_p", "_a", "_b", "_t")


def nearest_samples(points: DataFrame, step_km: float = 0.5) -> DataFrame:
    """The points nearest to every `step_km` along a route, ties to the earlier one, with the first and last; each once.

    A point owns the stretch between the midpoints to its neighbours, so a sample is
    found in the window, without a join of points and places.
    """
    w, whole = Window.partitionBy("route_id").orderBy("seq"), Window.partitionBy("route_id")
    d = F.col("distance_km")
    rows = points.withColumn("_from", (F.lag(d).over(w) + d) / 2).withColumn("_to", (F.lead(d).over(w) + d) / 2)
    rows = rows.withColumn("_first", F.min(d).over(whole)).withColumn("_last", F.max(d).over(whole))
    passed = lambda x: F.floor((x - F.col("_first")) / step_km)
    owns = passed(F.least(F.col("_to"), F.col("_last") - 1e-9)) > passed(F.col("_from"))
    return rows.where(F.col("_from").isNull() | F.col("_to").isNull() | owns).drop("_from", "_to", "_first", "_last")


def slope_changes(rows: DataFrame, delta: float = 5.0, bands: int = 2) -> DataFrame:
    """Points (route_id, seq, slope) at which the slope changes by so much and by so many speed bands; score: how much."""
    w = Window.partitionBy("route_id").orderBy("seq")
    both = rows.withColumn("_band", slope_band(F.col("slope"))).withColumn("_s", F.abs(F.col("slope") - F.lag("slope").over(w)))
    both = both.withColumn("_b", F.abs(F.col("_band") - F.lag("_band").over(w)))
    return both.where((F.col("_s") >= delta) & (F.col("_b") >= bands)).withColumn("score", F.col("_s") + F.col("_b")).drop("_band", "_s", "_b")


def weighted(rows: DataFrame) -> DataFrame:
    """Add weighted_km from the start: each step (step_km) divided by the multiplier of the mean slope of its ends."""
    w = Window.partitionBy("route_id").orderBy("seq")
    mean = (F.col("slope") + F.coalesce(F.lag("slope").over(w), F.col("slope"))) / 2
    step = rows.withColumn("_w", F.col("step_km") / slope_multiplier(mean))
    return step.withColumn("weighted_km", F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_w")


#: Kilometres between two segments up to which a way of several files counts as continuous. Fixed value.
CONTINUITY_KM = 0.1


def joined_profile(points: DataFrame) -> DataFrame:
    """One profile of a trip's files: distance_km, gain_m, loss_m and weighted_km run on over files and segments, gap_km tells the break before a segment.

    points: trip_id, file_number, segment_index, seq, latitude, longitude, elevation_m.  Breaks between
    segments are no way: they add nothing to the sums.  Slopes are told within a segment; the
    change to its last known elevation counts, never that to the segment before.
    """
    whole = Window.partitionBy("trip_id").orderBy("file_number", "segment_index", "seq")
    rows = local_slopes(cumulative(points.withColumn("route_id", F.struct("trip_id", "file_number", "segment_index")), "route_id"))
    mean = (F.col("slope") + F.coalesce(F.lag("slope").over(ordered("route_id")), F.col("slope"))) / 2
    rows = rows.withColumns({"_w": F.col("step_km") / slope_multiplier(mean), "_begins": F.lag("seq").over(ordered("route_id")).isNull()})
    running = whole.rowsBetween(Window.unboundedPreceding, 0)
    gap = haversine_km(F.lag("latitude").over(whole), F.lag("longitude").over(whole), F.col("latitude"), F.col("longitude"))
    sums = {"distance_km": "step_km", "gain_m": F.greatest("step_up_m", F.lit(0.0)), "loss_m": F.greatest(-F.col("step_up_m"), F.lit(0.0)), "weighted_km": "_w"}
    told = [F.sum(F.coalesce(c, F.lit(0.0))).over(running).alias(name) for name, c in sums.items()]
    return rows.select("trip_id", "file_number", "segment_index", "seq", "latitude", "longitude", "elevation_m", "slope", *told, F.when(F.col("_begins") & F.lag("seq").over(whole).isNotNull(), gap).alias("gap_km"))


def joined_summary(profile: DataFrame, tolerance_km: float = CONTINUITY_KM) -> DataFrame:
    """A row for each trip: its sums, the largest break, and whether it is continuous (files numbered without a gap, no break over the tolerance)."""
    ends = [F.max(c).alias(c) for c in ("distance_km", "gain_m", "loss_m", "weighted_km")]
    rows = profile.groupBy("trip_id").agg(
        F.countDistinct("file_number").alias("files"), F.countDistinct("file_number", "segment_index").alias("segments"), F.count("*").alias("points"), *ends, F.min("elevation_m").alias("min_m"), F.max("elevation_m").alias("max_m"),
        F.coalesce(F.max("gap_km"), F.lit(0.0)).alias("largest_gap_km"), F.min("file_number").alias("first_file"), F.max("file_number").alias("last_file"),
    )
    numbered = F.col("last_file") - F.col("first_file") + 1 == F.col("files")
    return rows.withColumn("continuous", numbered & (F.col("largest_gap_km") <= tolerance_km))
