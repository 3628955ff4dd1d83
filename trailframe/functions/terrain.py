"""Slope, speed, climb and pause rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailframe.functions.geo import clamp, js_round

# Fixed values: (highest slope in percent, multiplier) bands of the weighted distance; beyond the last, LEAST_MULTIPLIER.
SLOPE_BANDS = ((-8, 1.45), (-3, 1.2), (3, 1.0), (6, 0.78), (9, 0.58))
LEAST_MULTIPLIER = 0.42
# Knots (grade in percent, speed factor) of the piecewise-linear time model.
SPEED_KNOTS = ((-15, 2.2), (-8, 1.8), (-4, 1.35), (0, 1.0), (3, 0.78), (6, 0.56), (9, 0.42), (15, 0.32))
MIN_SPEED_KPH, MAX_SPEED_KPH = 3.0, 55.0
# Fixed values: (length km, gain m, average grade percent) that make a climb count; any one profile will do.
CLIMB_PROFILES = ((1.5, 100, 2), (1.0, 60, 3), (0.5, 40, 4))


def slope_multiplier(slope: Column) -> Column:
    """Step bands: the first whose bound is not passed."""
    out = None
    for bound, factor in SLOPE_BANDS:
        out = F.when(slope <= bound, F.lit(factor)) if out is None else out.when(slope <= bound, F.lit(factor))
    return out.otherwise(F.lit(LEAST_MULTIPLIER))


def slope_band(slope: Column) -> Column:
    """Index of the band."""
    out = None
    for i, (bound, _) in enumerate(SLOPE_BANDS):
        out = F.when(slope <= bound, F.lit(i)) if out is None else out.when(slope <= bound, F.lit(i))
    return out.otherwise(F.lit(len(SLOPE_BANDS)))


def speed_factor(grade: Column) -> Column:
    """Linear between knots, with the grade kept within the outer ones; a missing grade counts as flat."""
    g = clamp(F.coalesce(F.nanvl(grade, F.lit(0.0)), F.lit(0.0)), SPEED_KNOTS[0][0], SPEED_KNOTS[-1][0])
    out = F.when(g <= SPEED_KNOTS[0][0], F.lit(SPEED_KNOTS[0][1]))
    for (x0, y0), (x1, y1) in zip(SPEED_KNOTS, SPEED_KNOTS[1:], strict=False):
        out = out.when(g <= x1, F.lit(y0) + F.lit(y1 - y0) * ((g - x0) / F.lit(float(x1 - x0))))
    return out


def local_speed_kph(reference_kph: float, factor: Column) -> Column:
    return clamp(F.lit(float(reference_kph)) * factor, MIN_SPEED_KPH, MAX_SPEED_KPH)


def grade_class(grade: Column) -> Column:
    """Seven classes; descents are told apart first."""
    return (
        F.when(grade < -7, "descent-7-plus").when(grade < 0, "descent-0-7").when(grade < 1, "climb-0-1").when(grade < 4, "climb-1-4")
        .when(grade < 8, "climb-4-8").when(grade < 12, "climb-8-12").when(grade.isNotNull(), "climb-12-plus")
    )


def significant_climb(length_km: Column, gain_m: Column, average_grade: Column) -> Column:
    out = F.lit(False)
    for length, gain, grade in CLIMB_PROFILES:
        out = out | ((length_km >= length) & (gain_m >= gain) & (average_grade >= grade))
    return out


def break_budget_minutes(distance_km: Column, moving_minutes: Column, gain_m: Column) -> Column:
    """Automatic break: grows with the hours and the climbing, in steps of five minutes up to four hours."""
    hours = moving_minutes / 60
    rate = clamp(F.lit(3.6) + F.lit(1.295) * hours, 3.6, 16.0)
    steep = F.greatest(F.lit(0.0), F.coalesce(gain_m, F.lit(0.0))) / distance_km
    difficulty = F.lit(1.0) + clamp(steep - 5.0, 0.0, 60.0) / 60.0 * 0.8
    minutes = clamp(js_round(hours * rate * difficulty / 5) * 5.0, 0.0, 240.0)
    return F.when((distance_km > 0) & (moving_minutes > 0), minutes).otherwise(F.lit(0.0))


def pause_count(moving_minutes: Column) -> Column:
    """One pause under four hours, two under six, three under eight, then four."""
    return F.when(moving_minutes < 240, 1).when(moving_minutes < 360, 2).when(moving_minutes < 480, 3).otherwise(4)


#: Least length, gain and average grade of a major climb, by kind of country; any of the triples will do. Fixed values.
MAJOR = {
    False: CLIMB_PROFILES,
    True: ((4.0, 300.0, 3.0), (1.5, 150.0, 6.0)),
}


def climb_importance(length_km: Column, gain_m: Column, average_grade: Column, named: Column, mountains: bool) -> Column:
    """major or secondary; a climb with a name of its own is major whatever its size."""
    large = F.lit(False)
    for km, m, grade in MAJOR[mountains]:
        large = large | ((length_km >= km) & (gain_m >= m) & (average_grade >= grade))
    return F.when(named | large, "major").otherwise("secondary")


def waypoint_visible(kind: Column, importance: Column, paused: Column, show_secondary: bool = False) -> Column:
    """A pause shows a waypoint always; small climbs show on demand; of the rest, ends, passes, saddles and major climbs show."""
    small = (kind == "climb") & (importance == "secondary")
    shown = kind.isin("start", "end", "mountain-pass", "saddle", "pause") | ((kind == "climb") & (importance == "major"))
    return F.when(paused, True).when(small, show_secondary).otherwise(shown)
