"""Terrain series: smoothing, grids, grades, timing.  Two models exist and stay apart by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.functions.geo import clamp
from trailframe.functions.terrain import local_speed_kph, speed_factor

EPSILON = 1e-9


def ranged(expression: str, before: float, after: float, key: str = "route_id", by: str = "distance_km") -> Column:
    """A window expression over the rows within a distance; Spark's RANGE frame keeps it one sort."""
    return F.expr(f"{expression} OVER (PARTITION BY {key} ORDER BY {by} RANGE BETWEEN {before}D PRECEDING AND {after}D FOLLOWING)")


def smooth(series: DataFrame, window_km: float = 0.15, column: str = "elevation_m", to: str = "smoothed_m") -> DataFrame:
    """Mean of the known neighbours within half the window to either side."""
    return series.withColumn(to, ranged(f"avg({column})", window_km / 2, window_km / 2))


def grid(series: DataFrame, step_km: float) -> DataFrame:
    """route_id, k, target_km: multiples of the step, and the end."""
    total = series.groupBy("route_id").agg(F.max("distance_km").alias("total")).where(F.col("total") > EPSILON)
    n = F.ceil(F.col("total") / step_km - EPSILON).cast("int")
    ks = total.withColumn("k", F.explode(F.sequence(F.lit(0), n)))
    return ks.select("route_id", "k", F.least(F.col("k") * F.lit(step_km), F.col("total")).alias("target_km"))


def interpolate(series: DataFrame, targets: DataFrame, values: tuple[str, ...], fill_from_other_side: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Values of a series at target_km: linear between the last row before and the first at or after it.

    Series and targets are merged by one sort per route, with no range join: each
    target looks back and forth for the nearest row of the series.  `keep` names
    columns of the targets that come along, so that nothing has to be joined back.
    """
    struct = F.struct("distance_km", *values)
    carried = [F.struct(*keep).alias("_keep")] if keep else []
    kept = [F.lit(None).cast(targets.select(*carried).schema["_keep"].dataType).alias("_keep")] if keep else []
    rows = series.select("route_id", F.col("distance_km").alias("_at"), struct.alias("_p"), F.lit(None).cast("int").alias("k"), F.lit(1).alias("_kind"), *kept)
    asked = targets.select("route_id", F.col("target_km").alias("_at"), F.lit(None).cast(rows.schema["_p"].dataType).alias("_p"), F.col("k").cast("int"), F.lit(0).alias("_kind"), *carried)
    w = Window.partitionBy("route_id").orderBy("_at", "_kind", "k")
    # the next row is the last one seen from the other end: both frames grow row by row
    back = Window.partitionBy("route_id").orderBy(F.desc("_at"), F.desc("_kind"), F.desc("k"))
    first = F.last("_p", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    last = F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    near = rows.unionByName(asked).withColumn("_after", first).withColumn("_before", last).where("_kind = 0")
    near = near.withColumn("_b", F.coalesce("_after", "_before")).withColumn("_a", F.coalesce("_before", "_after"))
    span = F.col("_b.distance_km") - F.col("_a.distance_km")
    ratio = F.when(span <= EPSILON, F.lit(0.0)).otherwise(clamp((F.col("_at") - F.col("_a.distance_km")) / span, 0.0, 1.0))
    out = []
    for v in values:
        a, b = F.col(f"_a.{v}"), F.col(f"_b.{v}")
        if fill_from_other_side:
            a, b = F.coalesce(a, b), F.coalesce(b, a)
        out.append((a + (b - a) * ratio).alias(v))
    return near.select("route_id", "k", F.col("_at").alias("distance_km"), *out, *[F.col(f"_keep.{c}").alias(c) for c in keep])


def slope_profile(series: DataFrame, step_km: float = 0.05, grade_window_km: float = 0.2) -> DataFrame:
    """The stored profile: a grid over the smoothed series, grades from the grid's own points in the window."""
    resampled = interpolate(series, grid(series, step_km), ("smoothed_m", "latitude", "longitude"))
    half = grade_window_km / 2 + EPSILON
    ends = resampled.withColumn("_a", ranged("first(struct(distance_km as d, smoothed_m as e))", half, half)).withColumn(
        "_b", ranged("last(struct(distance_km as d, smoothed_m as e))", half, half)
    )
    span = F.col("_b.d") - F.col("_a.d")
    grade = clamp((F.col("_b.e") - F.col("_a.e")) / (span * 1000) * 100, -20.0, 20.0)
    return ends.withColumn("grade", F.when(span >= min(0.02, grade_window_km / 4), grade).otherwise(F.lit(0.0))).drop("_a", "_b")


def display_profile(series: DataFrame, step_km: float = 0.075, smoothing_km: float = 0.15, grade_window_km: float = 0.5) -> DataFrame:
    """The profile behind waypoint times: a grid first, then smoothing, then grades between interpolated elevations."""
    regular = interpolate(series, grid(series, step_km), ("elevation_m", "latitude", "longitude")).fillna(0.0, ["elevation_m"])
    smoothed = smooth(regular, smoothing_km + 2 * EPSILON)
    total = F.max("distance_km").over(Window.partitionBy("route_id"))
    half = grade_window_km / 2
    sided = smoothed.withColumn("left_km", F.greatest(F.lit(0.0), F.col("distance_km") - half)).withColumn("right_km", F.least(total, F.col("distance_km") + half))
    at = {}
    for side in ("left", "right"):
        asked = sided.select("route_id", "k", F.col(f"{side}_km").alias("target_km"))
        at[side] = interpolate(smoothed, asked, ("smoothed_m",)).select("route_id", "k", F.col("smoothed_m").alias(f"{side}_m"))
    joined = sided.join(at["left"], ["route_id", "k"]).join(at["right"], ["route_id", "k"])
    span = F.col("right_km") - F.col("left_km")
    grade = F.when(span <= EPSILON, F.lit(0.0)).otherwise(clamp((F.col("right_m") - F.col("left_m")) / (span * 1000) * 100, -20.0, 20.0))
    return joined.withColumn("grade", grade).drop("left_km", "right_km", "left_m", "right_m")


def timing(profile: DataFrame, reference_kph: float = 18.0) -> DataFrame:
    """Add local_kph and moving_minutes from the start: each interval goes at the mean factor of its ends."""
    w = Window.partitionBy("route_id").orderBy("k")
    factor = speed_factor(F.col("grade"))
    rows = profile.withColumn("_f", factor)
    mean = F.greatest(F.lit(0.1), (F.lag("_f").over(w) + F.col("_f")) / 2)
    step = F.greatest(F.lit(0.0), F.col("distance_km") - F.lag("distance_km").over(w))
    rows = rows.withColumn("_m", F.coalesce(step / local_speed_kph(reference_kph, mean) * 60, F.lit(0.0)))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*profile.columns, local_speed_kph(reference_kph, F.col("_f")).alias("local_kph"), F.sum("_m").over(running).alias("moving_minutes"))


def with_pauses(timed: DataFrame, pauses: DataFrame) -> DataFrame:
    """Add paused_minutes: pauses (route_id, pause_km, minutes) strictly before the point; one sort per route."""
    kind = F.lit(0).alias("_kind")
    rows = timed.select(*timed.columns, F.col("distance_km").alias("_at"), F.lit(0.0).alias("_pause"), kind)
    stops = pauses.select("route_id", (F.col("pause_km") + EPSILON).alias("_at"), F.col("minutes").cast("double").alias("_pause"), F.lit(1).alias("_kind"))
    w = Window.partitionBy("route_id").orderBy("_at", F.desc("_kind"), "k").rowsBetween(Window.unboundedPreceding, 0)
    merged = rows.unionByName(stops, allowMissingColumns=True).withColumn("paused_minutes", F.sum("_pause").over(w))
    return merged.where("_kind = 0").drop("_at", "_pause", "_kind")


def extrema(samples: DataFrame, around: int = 3, prominence_m: float = 75.0) -> DataFrame:
    """Summits and lows: the extreme among so many samples to either side, standing out from both sides."""
    w = Window.partitionBy("route_id").orderBy("k")
    before, after = w.rowsBetween(-around, -1), w.rowsBetween(1, around)
    e = F.col("elevation_m")
    sides = samples.withColumn("_n", F.count("*").over(before)).withColumn("_m", F.count("*").over(after))
    for name, fn in (("lo", F.min), ("hi", F.max)):
        sides = sides.withColumn(f"_{name}b", fn(e).over(before)).withColumn(f"_{name}a", fn(e).over(after))
    high = (e >= F.col("_hib")) & (e > F.col("_hia"))
    low = (e <= F.col("_lob")) & (e < F.col("_loa"))
    up = F.least(e - F.col("_lob"), e - F.col("_loa"))
    down = F.least(F.col("_hib") - e, F.col("_hia") - e)
    kind = F.when(high & (up >= prominence_m), "summit").when(low & (down >= prominence_m), "low")
    prominence = F.when(kind == "summit", up).otherwise(down)
    whole = (F.col("_n") == around) & (F.col("_m") == around)
    return sides.where(whole & kind.isNotNull()).select("route_id", "k", "distance_km", "elevation_m", kind.alias("kind"), prominence.alias("prominence_m"))
