"""Forecasts joined to timed points, hazards, alert groups, day risk, departure scenarios and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.functions.clock import ntz_seconds
from trailframe.functions.weather import ESSENTIAL, add_hazards, exposed, worst_code

TOLERANCE_MINUTES = 60
MINIMUM_COVERAGE = 0.8
# Fixed value: older answers aren't trusted.
TRUSTED_HOURS = 6
# Departure shifts compared, in minutes, and the margins that make a change worth while.
OFFSETS = (-120, -60, 0, 60, 120)
RED_FEWER, ORANGE_FEWER, RAIN_LESS_MM, GUST_LESS_KPH, EXPOSED_WARMER_C = 1, 2, 2.0, 15.0, 5.0
VARIABLES = ("apparent_c", "precipitation_mm", "precipitation_pct", "snowfall_cm", "weather_code", "wind_kph", "gust_kph", "visibility_m", "freezing_m")


def nearest_hour(points: DataFrame, hours: DataFrame, tolerance: int = TOLERANCE_MINUTES) -> DataFrame:
    """Left join of points (location_id, eta) to the nearest forecast hour within the tolerance; a tie goes to the earlier one.

    An hour within the tolerance lies in an hour bucket near that of the eta, so
    each bucket of a place has the few hours in its reach in one row: points meet
    it in one equi-join on place and bucket, in their own row, and the nearest is
    chosen there.  Buckets are counted without a time zone.
    """
    reach = -(-tolerance // 60)
    bucket = lambda c: F.floor(ntz_seconds(F.col(c)) / 3600)
    near = hours.select("location_id", F.struct(F.col("time"), ntz_seconds(F.col("time")).alias("at"), F.struct(*VARIABLES).alias("v")).alias("h"), bucket("time").alias("b"))
    near = near.withColumn("b", F.explode(F.expr(f"sequence(b - {reach}, b + {reach})")))
    ready = near.groupBy(F.col("location_id").alias("_location"), F.col("b").alias("_bucket")).agg(F.collect_list("h").alias("_hours"))
    joined = points.withColumn("_at", ntz_seconds(F.col("eta"))).withColumn("_b", F.floor(F.col("_at") / 3600))
    joined = joined.join(ready, (F.col("location_id") == F.col("_location")) & (F.col("_b") == F.col("_bucket")), "left")
    far = lambda h: F.abs(h["at"] - F.col("_at")) / 60
    best = F.array_min(F.transform(F.filter("_hours", lambda h: far(h) <= tolerance), lambda h: F.struct(far(h).alias("far"), h["time"].alias("time"), h["v"].alias("v"))))
    joined = joined.withColumn("_best", best)
    return joined.select(*points.columns, F.col("_best.time").alias("forecast_time"), F.col("_best.far").alias("minutes_off"), *[F.col(f"_best.v.{v}").alias(v) for v in VARIABLES])


def associate(points: DataFrame, hours: DataFrame, horizon_start, horizon_end) -> DataFrame:
    """Points with their hour and a state: available, or why not (no location, outside the horizon, no hour near)."""
    known = hours.groupBy(F.col("location_id").alias("_known")).agg(F.count("*").alias("_hours"))
    near = nearest_hour(points, hours).join(known, F.col("location_id") == F.col("_known"), "left")
    state = (
        F.when(F.col("_hours").isNull(), "location-missing").when((F.col("eta") < horizon_start) | (F.col("eta") > horizon_end), "outside-forecast")
        .when(F.col("forecast_time").isNull(), "hour-missing").otherwise("available")
    )
    return near.withColumn("state", state).drop("_known", "_hours")


def hourly_summary(hours: DataFrame, *keys: str) -> DataFrame:
    """Null-safe extremes, worst code, and how many hours have each main variable."""
    out = [F.count("*").alias("hours"), worst_code(F.col("weather_code")).alias("worst_code")]
    for c in ("apparent_c", "wind_kph", "gust_kph", "precipitation_mm", "visibility_m"):
        finite = F.when(~F.isnan(c), F.col(c))  # max would return NaN
        out += [F.min(finite).alias(f"min_{c}"), F.max(finite).alias(f"max_{c}")]
    out.append(F.count("gust_kph").alias("with_gust"))
    return hours.groupBy(*keys).agg(*out)


def findings(points: DataFrame, *keep: str) -> DataFrame:
    """A row for each finding of each point, and one with nulls for a point without; `first` marks one row a point.

    Outer, as an inner explode makes the optimizer infer a filter on the findings
    and push it below the choice of the nearest hour, which would then be made again
    for each of their parts.
    """
    risky = add_hazards(points.withColumn("exposed", exposed(F.col("kind"), F.col("elevation_m"), F.col("strategic"))))
    rows = risky.select("day_id", "point_id", "eta", "upcoming", *keep, F.posexplode_outer("findings").alias("_at", "_f"))
    return rows.select("day_id", "point_id", "eta", "upcoming", *keep, "_f.*", (F.coalesce("_at", F.lit(0)) == 0).alias("first"))


def alerts(points: DataFrame) -> DataFrame:
    """One row a finding, in day order: `ord` by time, point and hazard rank."""
    rows = findings(points).where("level is not null").drop("first")
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("day_id").orderBy("eta", "point_id", "rank")))


def alert_groups(rows: DataFrame) -> DataFrame:
    """Runs of neighbouring alerts of a day with the same risk and level (gaps and islands)."""
    w = Window.partitionBy("day_id").orderBy("ord")
    new = F.coalesce((F.lag("risk").over(w) != F.col("risk")) | (F.lag("level").over(w) != F.col("level")), F.lit(True))
    marked = rows.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("day_id", "island").agg(
        F.min("risk").alias("risk"), F.min("level").alias("level"), F.count("*").alias("alerts"), F.count_distinct("point_id").alias("points"),
        F.min_by("point_id", "ord").alias("first_point"), F.max_by("point_id", "ord").alias("last_point"), F.min("eta").alias("first_eta"), F.max("eta").alias("last_eta"),
        F.max("value").alias("value"), F.bool_or("upcoming").alias("upcoming"),
    )


def coverage(points: DataFrame, *keys: str) -> DataFrame:
    """covered and missing points, and the share of essential ones (null without any) that have a forecast."""
    has, essential = F.col("forecast_time").isNotNull(), F.col("kind").isin(*ESSENTIAL)
    counted = points.groupBy(*keys).agg(F.count_if(has).alias("covered"), F.count_if(~has).alias("missing"), F.count_if(essential).alias("_all"), F.count_if(essential & has).alias("_has"))
    return counted.withColumn("coverage", F.when(F.col("_all") > 0, F.col("_has") / F.col("_all"))).drop("_all", "_has")


def doubts(now: Column, minimum: float, trusted_hours: int) -> Column:
    """What speaks against the data of a row with coverage and fetched_at."""
    age = (ntz_seconds(now) - ntz_seconds(F.col("fetched_at"))) / 3600
    return F.array_compact(F.array(F.when(F.col("coverage") < minimum, "forecast-coverage"), F.when(age > trusted_hours, "stale-data")))


def meta_alerts(days: DataFrame, now: Column, minimum: float = MINIMUM_COVERAGE, trusted_hours: int = TRUSTED_HOURS) -> DataFrame:
    """days(day_id, coverage, fetched_at): a row for each alert on the data itself, of level unknown and always upcoming."""
    return days.select("day_id", F.explode(doubts(now, minimum, trusted_hours)).alias("risk")).select("day_id", "risk", F.lit("unknown").alias("level"), F.lit(True).alias("upcoming"))


def day_risk(points: DataFrame, fetched: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """A day's level, counts of alert groups, essential coverage; missing coverage or stale data make a green day unknown.

    fetched: day_id and fetched_at of the answers, compared with `now`.
    """
    rows = findings(points.withColumn("_has", F.col("forecast_time").isNotNull()).withColumn("_essential", F.col("kind").isin(*ESSENTIAL)), "_has", "_essential")
    # alerts first, in day order; the groups are those of alert_groups, and the other rows are there to be counted
    w = Window.partitionBy("day_id").orderBy(F.col("level").isNull(), "eta", "point_id", "rank")
    new = F.col("level").isNotNull() & F.coalesce((F.lag("risk").over(w) != F.col("risk")) | (F.lag("level").over(w) != F.col("level")), F.lit(True))
    marked = rows.withColumn("_new", new.cast("int")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    once = F.col("first")
    groups = marked.groupBy("day_id", "_island").agg(
        F.min("level").alias("_level"), F.bool_or(F.col("upcoming") & F.col("level").isNotNull()).alias("_upcoming"), F.count_if(once & F.col("_has")).alias("covered"),
        F.count_if(once & ~F.col("_has")).alias("missing"), F.count_if(once & F.col("_essential")).alias("_all"), F.count_if(once & F.col("_essential") & F.col("_has")).alias("_known"),
    )
    of = lambda level: F.col("_level") == level
    days = groups.groupBy("day_id").agg(
        *(F.sum(c).alias(c) for c in ("covered", "missing", "_all", "_known")), F.count_if(of("red")).alias("red"), F.count_if(of("orange")).alias("orange"),
        F.count_if(of("red") & F.col("_upcoming")).alias("upcoming_red"), F.count_if(of("orange") & F.col("_upcoming")).alias("upcoming_orange"),
    )
    days = days.withColumn("coverage", F.when(F.col("_all") > 0, F.col("_known") / F.col("_all"))).drop("_all", "_known")
    answers = days.withColumn("fetched_at", F.lit(None).cast("timestamp_ntz")) if fetched is None else days.join(fetched, "day_id", "left")
    said = doubts(F.lit(None).cast("timestamp_ntz") if now is None else now, MINIMUM_COVERAGE, TRUSTED_HOURS)
    rows = answers.withColumn("unknown", F.size(said).cast("long")).drop("fetched_at")
    level = F.when(F.col("red") > 0, "red").when(F.col("orange") > 0, "orange").when(F.col("unknown") > 0, "unknown").otherwise("green")
    return rows.withColumn("level", level)


def scenarios(points: DataFrame, hours: DataFrame, offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """Every point at every departure shift, joined anew to its hour.

    The shifts are a constant array that is exploded in place: no join makes them.
    """
    shifted = points.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets])))
    shifted = shifted.withColumn("eta", F.timestamp_add("MINUTE", F.col("offset"), F.col("eta")))
    return nearest_hour(shifted, hours)


def scenario_summary(shifted: DataFrame) -> DataFrame:
    """Extremes, alert counts and coverage of each day and shift; shifted(date: the day's date, ...).

    A shift to before the day's own midnight isn't coherent.
    """
    rows = add_hazards(shifted.withColumn("exposed", exposed(F.col("kind"), F.col("elevation_m"), F.col("strategic"))))
    level = lambda name: F.size(F.filter("findings", lambda x: x["level"] == name))
    essential, has = F.col("kind").isin(*ESSENTIAL), F.col("forecast_time").isNotNull()
    return rows.groupBy("day_id", "offset").agg(
        F.sum(level("red")).alias("red"), F.sum(level("orange")).alias("orange"), F.count("forecast_time").alias("covered"),
        F.max("precipitation_mm").alias("rain_mm"), F.max("gust_kph").alias("gust_kph"), F.min("apparent_c").alias("apparent_c"),
        F.min(F.when(F.col("exposed"), F.col("apparent_c"))).alias("exposed_c"), F.min("visibility_m").alias("visibility_m"),
        F.min(F.col("eta") >= F.col("date").cast("timestamp_ntz")).alias("coherent"),
        (F.count_if(essential & has) / F.nullif(F.count_if(essential), F.lit(0))).alias("coverage"),
    )


def ranked(summary: DataFrame) -> DataFrame:
    """Best shift first; those that aren't coherent last.  Ascending keys have nulls last, descending ones first."""
    order = [
        F.desc("coherent"), F.asc("red"), F.asc("orange"), F.desc("covered"), F.asc_nulls_last("rain_mm"), F.asc_nulls_last("gust_kph"),
        F.desc_nulls_first("apparent_c"), F.desc_nulls_first("visibility_m"), F.abs("offset").asc(), F.asc("offset"),
    ]
    return summary.withColumn("rank", F.row_number().over(Window.partitionBy("day_id").orderBy(*order)))


def recommendation(ranking: DataFrame, context: DataFrame) -> DataFrame:
    """For each day: keep the current departure, or change to a clearly better one, if that can be said at all.

    context: day_id, mode (of display), departed (boolean), age_hours (of the answer, null if unknown).
    Only an operational or a live day before its departure can be advised on
    (else not-applicable), and only with enough and fresh data (else insufficient-data).
    """
    fields = ("offset", "red", "orange", "rain_mm", "gust_kph", "exposed_c", "coverage")
    now = F.max_by(F.struct(*fields), F.when(F.col("offset") == 0, F.lit(1))).alias("now")
    best = F.min_by(F.struct(*fields), F.when(F.col("coherent"), F.col("rank"))).alias("best")
    days = ranking.groupBy("day_id").agg(now, best).join(context.select("day_id", "mode", "departed", "age_hours"), "day_id", "left")
    less = lambda c, by: F.coalesce(F.col(f"now.{c}") - F.col(f"best.{c}") >= by, F.lit(False))
    warmer = F.coalesce(F.col("best.exposed_c") - F.col("now.exposed_c") >= EXPOSED_WARMER_C, F.lit(False))
    better = less("red", RED_FEWER) | less("orange", ORANGE_FEWER) | less("rain_mm", RAIN_LESS_MM) | less("gust_kph", GUST_LESS_KPH) | warmer
    open_ = F.coalesce(F.col("mode").isin("operational", "live"), F.lit(False)) & ~((F.col("mode") == "live") & F.coalesce("departed", F.lit(False)))
    poor = F.coalesce(F.col("now.coverage") < MINIMUM_COVERAGE, F.lit(False)) | F.coalesce(F.col("age_hours") > TRUSTED_HOURS, F.lit(False))
    status = (
        F.when(~open_ | F.col("now").isNull(), "not-applicable").when(poor, "insufficient-data")
        .when((F.col("best.offset") == 0) | F.col("best").isNull() | ~better, "keep-current").otherwise("recommended-change")
    )
    return days.select("day_id", status.alias("status"), F.when(status == "recommended-change", F.col("best.offset")).alias("offset"))


def off_day_weather(days: DataFrame, hours: DataFrame) -> DataFrame:
    """days(day_id, location_id, date) without a ride: hours, coldest and gust of their place on their date; days without an hour have none."""
    dated = hours.withColumn("date", F.col("time").cast("date"))
    rows = days.join(dated, ["location_id", "date"])
    return rows.groupBy("day_id").agg(F.count("*").alias("hours"), F.min("apparent_c").alias("coldest"), F.max("gust_kph").alias("gust"))


def live_progress(points: DataFrame, now: Column) -> DataFrame:
    """Points of a day in time order as past, next (the first later than now) or upcoming."""
    order = Window.partitionBy("day_id").orderBy("eta", "point_id")
    later = F.col("eta") > now
    rows = points.withColumn("_later", later).withColumn("_first", F.min(F.when(later, F.struct("eta", "point_id"))).over(Window.partitionBy("day_id")))
    state = F.when(~F.col("_later"), "past").when(F.struct("eta", "point_id") == F.col("_first"), "next").otherwise("upcoming")
    return rows.withColumn("state", state).withColumn("position", F.row_number().over(order)).drop("_later", "_first")


def today_reference(daily: DataFrame, today: Column) -> DataFrame:
    """daily(request, date, min_c, max_c, rain_mm, rain_pct, wind_kph, gust_kph, weather_code): today's extremes over all places of an answer."""
    return daily.where(F.col("date") == today).groupBy("request").agg(
        F.min("min_c").alias("min_c"), F.max("max_c").alias("max_c"), F.max("rain_mm").alias("rain_mm"), F.max("rain_pct").alias("rain_pct"),
        F.max("wind_kph").alias("wind_kph"), F.max("gust_kph").alias("gust_kph"), worst_code(F.col("weather_code")).alias("worst_code"),
    )


def latest_fresh(cache: DataFrame, now, ttl_minutes: int = 30) -> DataFrame:
    """The newest answer to each request and whether it is still fresh (to be shown, and fetched again if not)."""
    newest = cache.groupBy("request").agg(F.max("fetched_at").alias("fetched_at"), F.max_by("payload", "fetched_at").alias("payload"))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))) / 60e6
    return newest.withColumn("fresh", age <= ttl_minutes)


def primary_alerts(rows: DataFrame, points: DataFrame) -> DataFrame:
    """The alert that a day's view begins with: red before orange, at the highest pass before elsewhere, then the earliest."""
    main = points.where(F.col("kind").isin("col", "summit")).groupBy("day_id").agg(F.max_by("point_id", F.struct("elevation_m", -F.col("point_id"))).alias("_main"))
    some = rows.where(F.col("level").isin("red", "orange")).join(main, "day_id", "left")
    order = F.struct((F.col("level") != "red").cast("int").alias("l"), F.coalesce((F.col("point_id") != F.col("_main")).cast("int"), F.lit(1)).alias("m"), "eta", "ord")
    return some.groupBy("day_id").agg(F.min_by(F.struct("point_id", "risk", "level", "eta"), order).alias("b")).select("day_id", "b.*")


def retained(results: DataFrame, place: str, order: tuple[str, ...], ok: Column, payload: str) -> DataFrame:
    """Failed fetches take the last good payload of their place; `retained` says so, null stays where there was none."""
    w = Window.partitionBy(place).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    good = F.last(F.when(ok, F.col(payload)), ignorenulls=True).over(w)
    return results.withColumn("_good", good).withColumn("retained", ~ok & F.col("_good").isNotNull()).withColumn(payload, F.col("_good")).drop("_good")
