"""Queries of the reference's operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailframe.functions import clock, geo, terrain as rules, weather
from trailframe.operators import climbs, forecast, quality, roadbook, spatial, stages, terrain, track, trip, waypoints
from trailframe.plans.carriers import hourly, stops, table, track_points

HORIZON = ("2024-01-02 00:00:00", "2024-01-25 00:00:00")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at the edge of a query, where engines differ in the last bits; no negative zero."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def series(spark, sf_dir) -> DataFrame:
    return track.cumulative(track_points(spark, sf_dir), "route_id")


def track_metrics(spark, sf_dir):
    return rounded(track.metrics(track_points(spark, sf_dir), "route_id"))


def track_summary_by_segment(spark, sf_dir):
    return rounded(track.summary_by_segment(track_points(spark, sf_dir)))


def track_cumulative(spark, sf_dir):
    return rounded(series(spark, sf_dir).select("route_id", "seq", "distance_km", "distance_m"), 5)


def track_segment_gaps(spark, sf_dir):
    return rounded(track.segment_gaps(track_points(spark, sf_dir), 0.035))


def track_backward_time(spark, sf_dir):
    late = F.when(F.col("seq") % 7 != 3, F.timestamp_add("MINUTE", -(F.col("seq") % 11) * 200, F.col("ts")))
    return track.first_backward_time(track_points(spark, sf_dir).withColumn("ts", late))


def track_bounds(spark, sf_dir):
    return rounded(track.bounds(track_points(spark, sf_dir)))


def track_valid_coordinates(spark, sf_dir):
    bent = track_points(spark, sf_dir).withColumn("latitude", F.when(F.col("seq") % 13 != 5, F.col("latitude") * F.when(F.col("seq") % 17 == 4, 2.5).otherwise(1.0)))
    return track.invalid_points(bent)


def track_continuity(spark, sf_dir):
    return rounded(track.continuity(track_points(spark, sf_dir)))


def track_even_sample(spark, sf_dir):
    return rounded(track.even_sample(track_points(spark, sf_dir), 5).select("route_id", "seq", "latitude", "longitude"))


def track_chunks(spark, sf_dir):
    per = track.chunks(series(spark, sf_dir), 700.0)
    return per.groupBy("route_id", "chunk").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("points"))


def track_local_slopes(spark, sf_dir):
    rows = track.local_slopes(series(spark, sf_dir))
    return rounded(rows.select("route_id", "seq", "slope", rules.slope_multiplier(F.col("slope")).alias("multiplier")), 4)


def track_slope_changes(spark, sf_dir):
    rows = track.slope_changes(track.local_slopes(series(spark, sf_dir)))
    return rows.groupBy("route_id").agg(F.count("*").alias("changes"), F.min("seq").alias("first_seq"))


def weighted_distance(spark, sf_dir):
    rows = track.weighted(track.local_slopes(series(spark, sf_dir)))
    return rounded(rows.groupBy("route_id").agg(F.max("weighted_km").alias("weighted_km"), F.max("distance_km").alias("distance_km")), 4)


def terrain_smoothed(spark, sf_dir):
    return rounded(terrain.smooth(series(spark, sf_dir)).select("route_id", "seq", "smoothed_m"), 4)


def slope_profile(spark, sf_dir) -> DataFrame:
    return terrain.slope_profile(terrain.smooth(series(spark, sf_dir)))


def terrain_slope_profile(spark, sf_dir):
    return rounded(slope_profile(spark, sf_dir).select("route_id", "k", "distance_km", "smoothed_m", "grade"), 3)


def terrain_display_profile(spark, sf_dir):
    return rounded(terrain.display_profile(series(spark, sf_dir)).select("route_id", "k", "distance_km", "smoothed_m", "grade"), 3)


def terrain_timing(spark, sf_dir):
    timed = terrain.timing(slope_profile(spark, sf_dir))
    return rounded(timed.groupBy("route_id").agg(F.max("moving_minutes").alias("minutes"), F.min("local_kph").alias("slowest"), F.max("local_kph").alias("fastest")), 3)


def terrain_pauses(spark, sf_dir):
    timed = terrain.timing(slope_profile(spark, sf_dir)).select("route_id", "k", "distance_km", "moving_minutes")
    ends = timed.groupBy("route_id").agg(F.max("distance_km").alias("total"))
    stops_ = ends.select("route_id", F.inline(F.array(*[F.struct((F.col("total") * F.lit(f)).alias("pause_km"), F.lit(m).alias("minutes")) for f, m in ((0.25, 15.0), (0.5, 30.0), (0.75, 15.0))])))
    rows = terrain.with_pauses(timed, stops_)
    total = F.col("moving_minutes") + F.col("paused_minutes")
    at = clock.clock(F.lit(1430), total)
    rows = rows.select("route_id", "k", "paused_minutes", at.alias("c"))
    return rows.select("route_id", "k", "paused_minutes", "c.*", clock.clock_text(F.col("c.clock_minutes"), F.col("c.day_offset")).alias("text"))


def terrain_extrema(spark, sf_dir):
    samples = slope_profile(spark, sf_dir).select("route_id", "k", "distance_km", F.col("smoothed_m").alias("elevation_m"))
    return rounded(terrain.extrema(samples, 3, 0.3).select("route_id", "k", "kind", "prominence_m"), 3)


def terrain_grade_classes(spark, sf_dir):
    graded = slope_profile(spark, sf_dir).withColumn("grade", F.round("grade", 4))
    return graded.groupBy(rules.grade_class(F.col("grade")).alias("grade_class")).agg(F.count("*").alias("points"))


def climb_detection(spark, sf_dir):
    steeper = slope_profile(spark, sf_dir).select("route_id", "k", "distance_km", (F.col("smoothed_m") * 3).alias("elevation_m"), "grade")
    return rounded(climbs.detect(steeper), 3)


def climb_tiles(spark, sf_dir):
    found = track.metrics(track_points(spark, sf_dir), "route_id").select("route_id", F.lit(1).alias("number"), F.lit(0.1).alias("start_km"), F.round("distance_km", 6).alias("end_km"))
    return rounded(climbs.tiles(found))


def feature_spacing(spark, sf_dir):
    features = series(spark, sf_dir).where("elevation_m is not null").select("route_id", "seq", "distance_km", F.round("elevation_m", 6).alias("score"))
    return climbs.spaced(features, 0.4).select("route_id", "seq")


def speed_rules(spark, sf_dir):
    grade = F.col("l_quantity") - 25
    rows = table(spark, sf_dir, "lineitem").select(grade.alias("grade")).distinct()
    factor = rules.speed_factor(F.col("grade"))
    return rounded(rows.select("grade", factor.alias("factor"), rules.local_speed_kph(22.0, factor).alias("kph"), rules.slope_multiplier(F.col("grade")).alias("multiplier"), rules.grade_class(F.col("grade")).alias("class")))


def break_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("km"), F.sum("l_tax").alias("tax"), F.count("*").alias("n"))
    minutes = F.round(F.col("km") * 3.3, 4)
    gain = F.when(F.col("n") != 3, F.round(F.col("tax") * 4000, 4))
    return rows.select("l_orderkey", rules.break_budget_minutes(F.col("km"), minutes, gain).alias("minutes"), rules.pause_count(minutes).alias("pauses"))


def pause_allocation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("total", F.pmod(F.col("l_orderkey"), F.lit(240)))
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return trip.allocate(rows, "l_orderkey", order, "total", "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "allocated")


def clock_shifts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 1440).cast("int").alias("m"), (F.round(F.col("o_totalprice") / 100 * 100) / 100).alias("e"))  # of the double itself, as the SQL: Spark rounds its shortest decimal text
    c = o.withColumn("c", clock.clock(F.col("m"), F.col("e"))).withColumn("s", clock.shifted_clock(F.col("c.clock_minutes"), F.col("c.day_offset"), F.lit(-120)))
    return c.select("o_orderkey", "c.clock_minutes", "c.day_offset", clock.clock_text(F.col("c.clock_minutes"), F.col("c.day_offset")).alias("text"),
        F.col("s.clock_minutes").alias("shifted"), F.col("s.coherent").alias("coherent"), clock.parse_clock(clock.clock_text(F.col("c.clock_minutes"), F.lit(0))).alias("parsed"),
        clock.local_timestamp(F.lit("2024-03-30").cast("date"), F.col("c.clock_minutes"), F.col("c.day_offset")).alias("at"))


def hourly_summary(spark, sf_dir):
    return rounded(forecast.hourly_summary(hourly(spark, sf_dir), "location_id"), 8)


def daily_summary(spark, sf_dir):
    return rounded(forecast.hourly_summary(hourly(spark, sf_dir).withColumn("date", F.date_format("time", "yyyy-MM-dd")), "location_id", "date"), 8)


def nearest_hours(spark, sf_dir):
    rows = forecast.nearest_hour(stops(spark, sf_dir), hourly(spark, sf_dir))
    return rounded(rows.select("point_id", "forecast_time", "minutes_off", "apparent_c", "weather_code"), 8)


def ride_association(spark, sf_dir):
    some = stops(spark, sf_dir).withColumn("location_id", F.when(F.col("location_id") == 24, 99).otherwise(F.col("location_id")))
    rows = forecast.associate(some, hourly(spark, sf_dir), ntz(HORIZON[0]), ntz(HORIZON[1]))
    return rows.select("point_id", "state", "forecast_time")


def off_day_association(spark, sf_dir):
    days = stops(spark, sf_dir).groupBy("day_id").agg(F.min("location_id").alias("location_id"), F.min("eta").cast("date").alias("date"))
    return rounded(forecast.off_day_weather(days, hourly(spark, sf_dir)), 8)


def timed(spark, sf_dir) -> DataFrame:
    near = forecast.nearest_hour(stops(spark, sf_dir), hourly(spark, sf_dir))
    return near.withColumn("upcoming", F.col("eta") >= ntz("2024-01-15 12:00:00"))


def hazard_findings(spark, sf_dir):
    return rounded(forecast.alerts(timed(spark, sf_dir)).select("day_id", "point_id", "rank", "risk", "level", "value"), 8)


def alert_groups(spark, sf_dir):
    return rounded(forecast.alert_groups(forecast.alerts(timed(spark, sf_dir))), 8)


def fetched(spark, sf_dir) -> DataFrame:
    return stops(spark, sf_dir).select("day_id").distinct().withColumn("fetched_at", F.timestamp_add("HOUR", -(F.col("day_id") % 13), ntz("2024-01-15 12:00:00")))


def day_risk(spark, sf_dir):
    return rounded(forecast.day_risk(timed(spark, sf_dir), fetched(spark, sf_dir), ntz("2024-01-15 12:30:00")), 6)


def live_progress(spark, sf_dir):
    return forecast.live_progress(stops(spark, sf_dir), ntz("2024-01-15 12:00:00")).select("day_id", "point_id", "position", "state")


def today_reference(spark, sf_dir):
    daily = hourly(spark, sf_dir).select(
        (F.col("location_id") % 7).alias("request"), F.col("time").cast("date").alias("date"), F.col("apparent_c").alias("min_c"), (F.col("apparent_c") + 5).alias("max_c"),
        F.col("precipitation_mm").alias("rain_mm"), F.col("precipitation_pct").alias("rain_pct"), "wind_kph", "gust_kph", "weather_code",
    )
    return rounded(forecast.today_reference(daily, F.lit("2024-01-10").cast("date")), 8)


def scenario_ranking(spark, sf_dir):
    return rounded(forecast.ranked(forecast.scenario_summary(forecast.scenarios(stops(spark, sf_dir), hourly(spark, sf_dir)))), 8)


def recommendations(spark, sf_dir):
    ranking = forecast.ranked(forecast.scenario_summary(forecast.scenarios(stops(spark, sf_dir), hourly(spark, sf_dir))))
    d = F.col("day_id")
    modes = F.element_at(F.array(*[F.lit(m) for m in ("operational", "live", "planning", "operational", "live")]), d % 5 + 1)
    context = ranking.select("day_id").distinct().select(d, modes.alias("mode"), (d % 3 == 0).alias("departed"), F.when(d % 4 != 0, (d % 9).cast("double")).alias("age_hours"))
    return forecast.recommendation(ranking, context)


def weather_codes(spark, sf_dir):
    h = hourly(spark, sf_dir)
    return h.groupBy("weather_code").agg(F.count("*").alias("hours"), F.first(weather.severity(F.col("weather_code"))).alias("severity"))


def display_modes(spark, sf_dir):
    s = stops(spark, sf_dir).withColumn("date", F.col("eta").cast("date"))
    covered = F.when(F.col("location_id") != 3, F.lit("2024-01-05").cast("date"))
    mode = weather.display_mode(F.col("date"), F.lit("2024-01-10").cast("date"), covered, F.lit("2024-01-22").cast("date"))
    return s.groupBy(mode.alias("mode")).agg(F.count("*").alias("points"))


def forecast_cache(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("request"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("payload"))
    return forecast.latest_fresh(e, "2024-01-30 23:59:00", 240)


def places(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("place_id"), (F.lit(45.0) + (k % 150) * 0.01 + (k % 50) * 0.0003 + (k % 7) * 1e-4).alias("latitude"), (F.lit(6.0) + (k % 50) * 0.0003).alias("longitude"),
        F.when(k % 6 != 0, F.concat(F.lit("p"), (k % 9).cast("string"))).alias("name"), F.col("c_mktsegment").alias("category"), F.concat(F.lit("layer"), (k % 4).cast("string")).alias("layer"),
    )


def nearest_segments(spark, sf_dir):
    rows = spatial.nearest_segment(places(spark, sf_dir), track_points(spark, sf_dir), 250.0)
    return rounded(rows.select("place_id", "route_id", "segment", "lateral_m", "ratio"), 3)


def places_in_corridor(spark, sf_dir):
    return spatial.routes_in_reach(places(spark, sf_dir), track_points(spark, sf_dir), 1500.0)


def thinned_places(spark, sf_dir):
    near = spatial.nearest_segment(places(spark, sf_dir), track_points(spark, sf_dir), 250.0).withColumn("lateral_m", F.round("lateral_m", 4))
    rows = near.join(places(spark, sf_dir), "place_id").where("name is not null").select("place_id", "route_id", "lateral_m", "latitude", "longitude", "name")
    return spatial.greedy_thinned(rows, "name", 40.0).select("place_id", "route_id")


def located(spark, sf_dir) -> DataFrame:
    near = spatial.nearest_segment(places(spark, sf_dir), track_points(spark, sf_dir), 250.0).withColumn("lateral_m", F.round("lateral_m", 4))
    k = F.col("place_id")
    kinds = F.element_at(F.array(*[F.lit(c) for c in ("water", "toilet", "bike-service", "bakery", "shelter")]), (k % 5 + 1).cast("int"))
    rows = places(spark, sf_dir).select("place_id", "name", "latitude", "longitude", kinds.alias("category"), (k % 2 == 0).alias("repair"), (k * 7 % 500).alias("source_id"))
    return near.select("place_id", "route_id", "lateral_m").join(rows, "place_id")


def corridor_places(spark, sf_dir):
    return spatial.corridor_places(located(spark, sf_dir), waypoints.name_key(F.col("name")), 240.0).select("route_id", "place_id")


def corridor_features(spark, sf_dir):
    rows = located(spark, sf_dir).withColumn("kind", F.when(F.col("category") == "water", "peak").otherwise("saddle"))
    return spatial.corridor_features(rows, waypoints.name_key(F.col("name")), F.when(F.col("kind") == "peak", 150.0).otherwise(250.0)).select("route_id", "place_id")


def nearest_named(spark, sf_dir):
    p = places(spark, sf_dir).select((F.col("place_id") % 150).alias("route_id"), F.col("place_id").alias("point_id"), "name", "latitude", "longitude")
    return rounded(spatial.nearest_named(p.select("route_id", F.col("point_id").alias("top_id"), (F.col("latitude") + 0.0004).alias("latitude"), "longitude"), p, 0.08), 4)


def largest_deviation(spark, sf_dir):
    pts = track_points(spark, sf_dir)
    simple = pts.where("seq % 9 = 0").union(pts.groupBy("route_id").agg(F.max_by(F.struct(*pts.columns), "seq").alias("p")).select("p.*").where("seq % 9 <> 0"))
    return rounded(spatial.largest_deviation(pts, simple, 500.0), 4)


def unique_places(spark, sf_dir):
    near = spatial.nearest_segment(places(spark, sf_dir), track_points(spark, sf_dir), 250.0).withColumn("lateral_m", F.round("lateral_m", 4))
    rows = near.join(places(spark, sf_dir).select("place_id", "layer"), "place_id")
    return spatial.nearest_row_per_key(rows, "route_id", "layer").select("route_id", "layer", "place_id")


def similar_tracks(spark, sf_dir):
    pts = track_points(spark, sf_dir).withColumn("latitude", F.col("latitude") - F.floor(F.col("route_id") / 3) * 0.01 * 2 + F.floor(F.col("route_id") / 3) % 2 * 0.02)
    length = series(spark, sf_dir).groupBy("route_id").agg(F.max("distance_km").alias("distance_km"))
    some = track.even_sample(pts, 5).groupBy("route_id").agg(F.expr("transform(array_sort(collect_list(struct(seq, latitude, longitude))), p -> struct(p.latitude, p.longitude))").alias("samples"))
    return rounded(spatial.similar_tracks(length.join(some, "route_id"), 0.5, 0.3, 0.5, 0.8), 4)


def duplicate_files(spark, sf_dir):
    return spatial.strict_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def days(spark, sf_dir) -> DataFrame:
    """Orders of a customer by date are the days of a trip."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.sum("l_tax") * 1000, 2).alias("t"))
    position = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    kind = F.when(F.col("o_orderstatus") != "P", "ride").when(F.col("o_orderkey") % 2 == 0, "off").otherwise("transfer")
    p = F.col("o_orderpriority")
    return o.join(lines, "o_orderkey", "left").select(
        F.col("o_custkey").alias("trip_id"), position.alias("position"), F.col("o_orderkey").alias("day_id"), kind.alias("kind"), ((kind == "transfer") & (F.col("o_orderkey") % 4 == 1)).alias("attached"),
        F.when((kind == "ride") & (p != "5-LOW"), F.col("q")).alias("distance_km"), F.when(kind == "ride", F.col("t")).alias("gain_m"),
        F.when((kind == "ride") & (p != "1-URGENT"), F.concat(F.lit("d"), p)).alias("departure"), F.when((kind == "ride") & (p != "2-HIGH"), F.concat(F.lit("a"), p)).alias("arrival"),
        F.when((kind != "ride") & (p == "3-MEDIUM"), F.lit("by hand")).alias("manual"), F.col("o_orderdate").cast("date").alias("order_date"),
    )


def dated(spark, sf_dir) -> DataFrame:
    return trip.calendar(days(spark, sf_dir), F.lit("2024-06-01").cast("date"))


def trip_totals(spark, sf_dir):
    return rounded(trip.trip_totals(days(spark, sf_dir)), 4)


def trip_calendar(spark, sf_dir):
    return dated(spark, sf_dir).select("trip_id", "day_id", "index", "display_number", F.col("date").cast("string").alias("date"))


def trip_fill_places(spark, sf_dir):
    return trip.fill_places(days(spark, sf_dir))


def trip_progress(spark, sf_dir):
    return rounded(trip.progress(dated(spark, sf_dir), F.lit("2024-06-08").cast("date")).withColumn("next_date", F.col("next_date").cast("string")), 4)


def trip_highlight(spark, sf_dir):
    return trip.highlighted(dated(spark, sf_dir), F.lit("2024-06-12").cast("date"))


def trip_preferred(spark, sf_dir):
    spans = days(spark, sf_dir).groupBy("trip_id").agg(F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"))
    return trip.preferred_trip(spans.withColumn("owner", F.col("trip_id") % 20), F.lit("1995-06-17").cast("date"))


def reference_points(spark, sf_dir):
    return trip.reference_points(stops(spark, sf_dir))


def stage_members(spark, sf_dir):
    ids = F.expr("transform(array_sort(collect_list(struct(l_linenumber, l_partkey))), x -> x.l_partkey + if(x.l_linenumber = 3, 10000000, 0))")
    stages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(ids.alias("ids"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return trip.members_in_order(stages, "ids", parts, "p_partkey").select("l_orderkey", "pos", "p_partkey", "p_size")


def days_of_place(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_list(F.col("l_orderkey") % 30).alias("ids"))
    wanted = spark.range(10).select(F.col("id").alias("day"))
    return trip.holding(held, "ids", wanted, "day").groupBy("day").agg(F.count("*").alias("places"))


def planned_files(spark, sf_dir):
    plan = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("file_name"))
    files = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("file_name"))
    return trip.planned_files(plan, files)


def upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("old").alias("version"))
    new = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit("new").alias("version"))
    return trip.replace_by_key(old, new, "c_custkey")


def unique_name_matches(spark, sf_dir):
    left = table(spark, sf_dir, "supplier").select(F.col("s_suppkey"), (F.col("s_suppkey") * 13 % 1300).alias("k"))
    right = table(spark, sf_dir, "part").select((F.col("p_partkey") % 1300).alias("k"), "p_partkey")
    return trip.unique_matches(left, right, "k", "p_partkey").select("s_suppkey", "p_partkey")


def enrichment_status(spark, sf_dir):
    return trip.status_rollup(table(spark, sf_dir, "events").withColumn("request", F.col("user_id") * 20 + F.col("event_id") % 20), "request", F.col("event_type") != "error")


def layer_counts(spark, sf_dir):
    return trip.layer_counts(places(spark, sf_dir))


def version_difference(spark, sf_dir):
    old = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select("p_partkey", "p_size", "p_brand")
    new = table(spark, sf_dir, "part").where("p_partkey % 11 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"), "p_brand")
    return trip.table_difference(old, new, "p_partkey")


def validation_issues(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 90 != 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 10_000_000).alias("o_custkey"), "o_totalprice", "o_orderpriority")
    doubled = o.union(o.where("o_orderkey % 500 = 0"))
    customers = table(spark, sf_dir, "customer")
    numbered = days(spark, sf_dir).withColumn("index", F.col("position") - 1 + (F.col("day_id") % 70 == 0).cast("int")).withColumn("km", F.col("position") * 10 - F.when(F.col("day_id") % 80 == 0, 10).otherwise(0))
    rules_ = {"price-range": F.col("o_totalprice") > 400_000, "bad-priority": ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")}
    return quality.gathered(
        quality.rule_issues(o, "o_orderkey", rules_), quality.duplicate_issues(doubled, "o_orderkey"), quality.reference_issues(o, "o_orderkey", "o_custkey", customers, "c_custkey"),
        quality.sequence_issues(numbered, "day_id", "trip_id", "index"), quality.increasing_issues(numbered, "day_id", "trip_id", "position", "km"),
    )


def schema_versions(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 9 != 0, (F.col("p_size") % 9 - 1)).cast("int").alias("schema_version"))
    return quality.versions(rows, 5, (2, 3, 4)).groupBy("status").agg(F.count("*").alias("bundles"))


def expanded_boxes(spark, sf_dir):
    b = track.bounds(track_points(spark, sf_dir))
    return rounded(b.select("route_id", geo.expanded_box(F.col("south"), F.col("west"), F.col("north"), F.col("east"), 500.0).alias("b")).select("route_id", "b.*"))


def name_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("name"))
    return d.select("doc_id", waypoints.name_key(F.col("name")).alias("key"), waypoints.name_words(F.col("name")).alias("words"))


def climb_landmarks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    route = F.col("o_custkey") % 100
    climbs_ = o.where("o_orderkey % 3 = 0").select(route.alias("route_id"), F.col("o_orderkey").alias("climb_id"), F.round(F.col("o_totalprice") % 200, 2).alias("end_km"))
    p = F.col("o_orderpriority")
    marks = o.where("o_orderkey % 3 <> 0").select(
        route.alias("route_id"), F.col("o_orderkey").alias("landmark_id"), F.when(p != "5-LOW", p).alias("name"), F.when(p == "1-URGENT", "mountain-pass").otherwise("saddle").alias("kind"),
        F.round(F.col("o_totalprice") % 200, 2).alias("track_km"),
    )
    return waypoints.climb_landmarks(climbs_, marks)


def simplified_tracks(spark, sf_dir):
    return waypoints.simplified(track_points(spark, sf_dir).select("route_id", "seq", "latitude", "longitude"), 10).select("route_id", "seq")


def file_ordering(spark, sf_dir):
    p = track_points(spark, sf_dir)
    ends = p.groupBy("chain", "route_id").agg(
        F.min_by("latitude", "seq").alias("lat1"), F.min_by("longitude", "seq").alias("lon1"), F.max_by("latitude", "seq").alias("lat2"), F.max_by("longitude", "seq").alias("lon2")
    )
    number = F.when(F.col("chain") % 2 == 0, -F.col("route_id")).cast("int")
    files = ends.select(F.col("chain").cast("long").alias("trip_id"), F.concat(F.lit("f"), F.col("route_id").cast("string")).alias("file_name"), number.alias("number"), "lat1", "lon1", "lat2", "lon2")
    return waypoints.file_order(files)


def grouped_stops(spark, sf_dir):
    s = stops(spark, sf_dir)
    near = s.select("day_id", F.col("point_id").cast("long").alias("point_id"), (F.col("point_id") % 500 / 10).alias("track_km"), (F.lit(45.0) + F.col("point_id") % 500 * 0.0005).alias("latitude"), F.lit(6.0).alias("longitude"), (F.col("elevation_m") % 60).alias("elevation_m"))
    return waypoints.grouped_points(near)


def summit_names(spark, sf_dir):
    k = F.col("place_id")
    kind = F.when(k % 3 == 0, "mountain-pass").when(k % 3 == 1, "saddle").otherwise("peak")
    candidates = places(spark, sf_dir).select(k.alias("candidate_id"), "name", "latitude", "longitude", kind.alias("kind"), F.when(k % 4 != 0, (k % 300).cast("double")).alias("elevation_m"))
    s = F.col("s_suppkey")
    summits = table(spark, sf_dir, "supplier").select(
        s.alias("climb_id"), (F.lit(45.0) + (s % 150) * 0.01 + (s % 50) * 0.0003).alias("latitude"), (F.lit(6.0) + (s % 50) * 0.0003).alias("longitude"),
        F.when(s % 5 != 0, (s % 280).cast("double")).alias("elevation_m"),
    )
    return waypoints.summit_names(summits, candidates)


def custom_pauses(spark, sf_dir):
    pauses = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("day_id"), (F.col("l_suppkey") * 13 % 131).alias("place_id"), F.col("l_partkey").alias("pause_id"), F.col("l_linenumber").alias("order"),
        F.col("l_quantity").cast("long").alias("minutes"), (F.col("l_returnflag") != "A").alias("active"),
    )
    return waypoints.custom_pauses(pauses, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place_id")))


def stable_place_ids(spark, sf_dir):
    rough = places(spark, sf_dir).withColumn("latitude", F.round("latitude", 1)).withColumn("longitude", F.lit(6.0))
    return waypoints.stable_ids(rough).select("place_id", "stable_id")


def endpoint_names(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    route = F.col("o_custkey") % 100
    p = F.col("o_orderpriority")
    kind = F.when(F.col("o_orderstatus") == "F", "town").when(F.col("o_orderstatus") == "O", "village").otherwise("saddle")
    points = o.select(route.alias("route_id"), F.col("o_orderkey").alias("point_id"), kind.alias("kind"), F.when(p != "5-LOW", p).alias("name"), F.round(F.col("o_totalprice") % 20, 2).alias("track_km"))
    routes = spark.range(100).selectExpr("id as route_id", "case when id % 3 <> 0 then '1 Urgent' end as start_name", "if(id % 2 = 0, '2-high', 'elsewhere') as end_name", "20D as total_km")
    return waypoints.without_endpoint_names(points, routes).select("route_id", "point_id")


def waypoint_visibility(spark, sf_dir):
    q, x = F.col("l_quantity"), F.col("l_linenumber")
    named = x % 5 == 0
    kind = F.when(x % 4 == 0, "town").when(x % 4 == 1, "saddle").otherwise("climb")
    size = (q / 8, q * 9, q / 7, named)
    rows = table(spark, sf_dir, "lineitem").select(q, x, kind.alias("kind"), rules.climb_importance(*size, False).alias("rolling"), rules.climb_importance(*size, True).alias("mountain"), (F.col("l_returnflag") == "R").alias("paused"))
    rows = rows.withColumn("visible", rules.waypoint_visible(F.col("kind"), F.col("mountain"), F.col("paused")))
    return rows.groupBy("kind", "rolling", "mountain", "visible").agg(F.count("*").alias("waypoints"))


def documented_points(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    km = (F.col("o_orderkey") % 2000).cast("double")
    text = F.concat(F.lit("1 "), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.when(F.col("o_orderkey") % 3 == 0, ",5 m").when(F.col("o_orderkey") % 3 == 1, "").otherwise("m"))
    text = F.when(F.col("o_orderkey") % 7 != 0, text).otherwise("about 900")
    kind = F.when(F.col("o_orderstatus") == "F", "saddle").when(F.col("o_orderstatus") == "O", "town").otherwise("hamlet")
    return o.select("o_orderkey", geo.coordinate_status(km).alias("status"), geo.leading_number(text).alias("elevation_m"), geo.feature_reach_m(kind).alias("reach_m"))


def track_nearest_samples(spark, sf_dir):
    return track.nearest_samples(series(spark, sf_dir), 0.25).select("route_id", "seq")


def automatic_pauses(spark, sf_dir):
    rides = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("day_id")).agg(F.sum("l_quantity").alias("total_km"))
    return rounded(trip.automatic_pauses(rides.withColumn("break_minutes", F.col("day_id") % 100)))


def documented_totals(spark, sf_dir):
    return rounded(trip.all_or_nothing(days(spark, sf_dir), "trip_id", "distance_km", "gain_m"), 4)


def day_slots(spark, sf_dir):
    return waypoints.with_slots(days(spark, sf_dir)).select("trip_id", "day_id", "index", "ride_number")


def job_states(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("status"), F.when(F.col("event_type") == "click", F.col("event_id")).alias("progress"))
    return trip.job_states(e, "user_id", ("ts", "event_id"), "status", "progress")


def primary_alerts(spark, sf_dir):
    points = timed(spark, sf_dir)
    return forecast.primary_alerts(forecast.alerts(points), points)


def retained_forecasts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.col("event_id").alias("payload"))
    return forecast.retained(e, "user_id", ("ts", "event_id"), F.col("event_type") != "error", "payload").select("event_id", "payload", "retained")


def stage_timing(spark, sf_dir):
    timed = terrain.timing(slope_profile(spark, sf_dir)).groupBy("route_id").agg(F.max("moving_minutes").alias("m"), F.max("distance_km").alias("total_km"))
    r = F.col("route_id")
    stages_ = timed.select(r, "total_km", (F.lit(100.0) + r).alias("gain_m"), F.when(r % 7 != 0, F.col("m")).alias("moving_minutes"), F.when(r % 3 != 0, r % 5 * 10).alias("break_minutes"))
    return rounded(stages.stage_timing(stages_).select("route_id", "break_minutes", "moving_s", "pause_s", "total_s", "average_kph"), 3)


def pause_settings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    stages_ = o.select(k.alias("stage_id"), F.when(k % 3 == 0, "custom").when(k % 3 == 1, "automatic").alias("mode"))
    pauses = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("stage_id"), F.col("l_linenumber").alias("pause_id"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey")).alias("point_id"),
        (F.col("l_quantity") * 37).alias("seconds"), (F.col("l_partkey") % 4).alias("order"), (F.col("l_returnflag") != "R").alias("active"),
    )
    return stages.pause_settings(stages_, pauses, F.lit("custom"))


def stage_waypoints(spark, sf_dir) -> DataFrame:
    """The lines of an order are the waypoints of a route of a hundred kilometres."""
    line = table(spark, sf_dir, "lineitem")
    kinds = F.array(*[F.lit(x) for x in ("city", "town", "village", "mountain-pass", "saddle", "climb", "start")])
    n = F.col("l_linenumber")
    km = F.round((F.col("l_partkey") * 7 % 1000) / 10, 1)
    return line.select(
        F.col("l_orderkey").alias("route_id"), n.cast("long").alias("waypoint_id"), F.element_at(kinds, (F.col("l_suppkey") % 7 + 1).cast("int")).alias("kind"), km.alias("km"),
        (F.lit(45.0) + km * 0.01).alias("latitude"), F.lit(6.0).alias("longitude"), (F.lit(500.0) + km).alias("elevation_m"),
    )


def ideal_pauses(spark, sf_dir) -> DataFrame:
    rules_ = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(km).alias("km"), F.lit(m).alias("minutes")) for i, km, m in ((0, 25.0, 10), (1, 50.0, 20), (2, 75.0, 10))])
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("route_id"), F.inline(rules_))


def placed_pauses(spark, sf_dir):
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("route_id"), F.lit(100.0).alias("total_km"))
    return rounded(stages.placed_pauses(ideal_pauses(spark, sf_dir), stage_waypoints(spark, sf_dir), totals), 4)


def unused_places(spark, sf_dir):
    places_ = stage_waypoints(spark, sf_dir).select("route_id", F.col("waypoint_id").alias("place_id"), "km")
    return rounded(stages.unused_places(ideal_pauses(spark, sf_dir).select("route_id", "position", "km"), places_), 4)


def paused_waypoints(spark, sf_dir):
    ends = F.explode(F.array(*[F.struct(F.lit(x).alias("distance_km"), F.lit(45.0 + x * 0.01).alias("latitude"), F.lit(6.0).alias("longitude"), F.lit(500.0 + x).alias("elevation_m")) for x in (0.0, 40.0, 100.0)]))
    line = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("route_id"), ends.alias("p")).select("route_id", "p.*")
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("route_id"), F.lit(100.0).alias("total_km"))
    points = stage_waypoints(spark, sf_dir)
    rows = stages.with_placed(points, stages.placed_pauses(ideal_pauses(spark, sf_dir), points, totals), line)
    return rounded(rows.select("route_id", "position", "waypoint_id", "kind", "km", "latitude", "elevation_m", "pause_minutes"), 4)


def slot_edits(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_suppkey") % 4 == 0, "off").when(F.col("l_suppkey") % 4 == 1, "transfer").otherwise("ride")
    k = F.col("trip_id")
    slots = line.groupBy(F.col("l_orderkey").alias("trip_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", kind.alias("k")))), lambda x: x["k"]).alias("slots"))
    text = lambda c: F.array_join(c, ",")
    return slots.select(
        k, text(stages.inserted(F.col("slots"), (k % 9 - 2).cast("int"), F.lit("off"))).alias("inserted"), text(stages.removed(F.col("slots"), (k % 8 - 1).cast("int"))).alias("removed"),
        text(stages.moved(F.col("slots"), (k % 7 - 1).cast("int"), F.when(k % 2 == 0, 1).otherwise(-1))).alias("moved"),
    )


def time_markers(spark, sf_dir):
    rows = track.weighted(track.local_slopes(series(spark, sf_dir)))
    seeds = rows.select("route_id").distinct().select("route_id", (F.lit(2) * F.lit(0.6)).alias("weighted_km"))
    return rounded(stages.time_markers(rows, seeds, minutes=2.0).select("route_id", "marker", "weighted_km", "track_km"), 4)


def spans(spark, sf_dir) -> DataFrame:
    ends = series(spark, sf_dir).groupBy("route_id").agg(F.max("distance_km").alias("t"))
    cuts = F.inline(F.array(*[F.struct(F.lit(i).alias("k"), (F.col("t") * F.lit(a)).alias("low_km"), (F.col("t") * F.lit(b)).alias("high_km")) for i, (a, b) in enumerate(((0.1, 0.35), (0.3, 0.8), (0.9, 1.0)))]))
    return ends.select("route_id", cuts)


def altitudes_between(spark, sf_dir):
    return rounded(stages.between(series(spark, sf_dir), spans(spark, sf_dir)), 4)


def route_fingerprints(spark, sf_dir):
    points = track_points(spark, sf_dir)
    hashes = points.select("route_id").distinct().where("route_id % 3 = 0").withColumn("sha256", F.sha2(F.col("route_id").cast("string"), 256))
    rows = stages.route_fingerprints(points, hashes)
    return rows.select("route_id", F.length("fingerprint").alias("length"), F.md5("fingerprint").alias("md5"))


def column_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", waypoints.column_key(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("key"))


def weather_labels(spark, sf_dir):
    return hourly(spark, sf_dir).groupBy(weather.label(F.col("weather_code")).alias("label")).agg(F.count("*").alias("hours"))


def trip_periods(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    at = clock.trip_period(F.col("d"), F.lit("1994-03-01").cast("date"), F.lit("1997-06-30").cast("date"))
    return rows.groupBy(at["kind"].alias("kind")).agg(F.count("*").alias("orders"), F.sum(at["day"]).alias("days"), F.sum(at["days_until"]).alias("until"))


def waypoint_order(spark, sf_dir):
    coarse = stage_waypoints(spark, sf_dir).withColumn("km", F.floor(F.col("km") / 20).cast("double"))
    return stages.in_order(coarse).select("route_id", "waypoint_id", "position")


def point_roles(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    role = stages.point_role(F.when(F.col("o_orderstatus") == "F", "matched").otherwise("excluded"), k % 7 == 0)
    return o.groupBy(role.alias("role"), stages.counts_for_risk(role, k % 2 == 0).alias("counts")).agg(F.count("*").alias("points"))


def positions_at(spark, sf_dir):
    timed = terrain.timing(slope_profile(spark, sf_dir)).withColumn("elevation_m", F.col("smoothed_m")).where("elevation_m is not null")
    routes = timed.groupBy("route_id").agg((F.max("moving_minutes") + 3).alias("total_minutes")).select("route_id", "total_minutes", F.lit(100.0).alias("gain_m"), F.lit(50.0).alias("loss_m"))
    ids = track_points(spark, sf_dir).select("route_id").distinct()  # routes without a profile fall out by their totals; the profile isn't worked out for these
    stops_ = ids.select("route_id", F.inline(F.array(*[F.struct(F.lit(a).alias("start_minutes"), F.lit(b).alias("end_minutes")) for a, b in ((1.0, 2.0), (3.0, 5.0))])))
    asked = ids.select("route_id", F.inline(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(e).alias("elapsed")) for i, e in enumerate((-1.0, 0.5, 1.5, 2.5, 4.0, 6.0, 7.5))])))
    rows = stages.positions_at(timed, stops_, asked, routes)
    return rounded(rows.select("route_id", "k", "paused", "track_km", "elevation_m"), 4)


def downsampled_profiles(spark, sf_dir):
    profile = slope_profile(spark, sf_dir).select("route_id", "k", F.round("smoothed_m", 4).alias("elevation_m")).where("elevation_m is not null")
    return stages.downsampled(profile, 12).select("route_id", "k")


def calendar_issues(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("day_id"), F.col("o_orderdate").cast("date").alias("first"), (F.col("o_orderkey") % 9).alias("index"))
    k = F.col("day_id")
    rows = o.withColumn("date", F.date_add("first", (F.col("index") + (k % 40 == 0).cast("int")).cast("int"))).withColumn("first", F.when(k % 60 != 1, F.col("first")))
    return quality.date_issues(rows.withColumn("date", F.when(k % 120 != 1, F.col("date"))), "day_id", "date", "first", "index")


def documented(spark, sf_dir) -> DataFrame:
    """Lines of orders as documented points, with a list of editorial entries and one of suppressed points."""
    line = table(spark, sf_dir, "lineitem")
    status = F.element_at(F.array(*[F.lit(x) for x in ("matched", "needs-review", "unmatched")]), (F.col("l_suppkey") % 3 + 1).cast("int"))
    points = line.select(
        F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").alias("point_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), status.alias("status"),
        F.when(F.col("l_linenumber") == 1, "pause").otherwise("poi").alias("kind"),
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"))
    k = F.col("point_id")
    entries = part.where("point_id % 11 = 0").select(k, F.when(k % 2 == 0, "excluded").otherwise("informational").alias("resolution"), F.lit("said so").alias("justification"), F.when(k % 3 == 0, "shown").alias("display_name"))
    return roadbook.resolved(points, entries, part.where("point_id % 13 = 0"))


def resolved_points(spark, sf_dir):
    rows = documented(spark, sf_dir)
    return rows.groupBy("status", "resolution", "justification").agg(F.count("*").alias("points"), F.count_if(F.col("name") == "shown").alias("shown"))


def match_summaries(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip_id"), "o_orderpriority", "o_orderstatus")
    days_ = o.select("trip_id", F.when(F.col("o_orderpriority") == "5-LOW", "off").otherwise("ride").alias("kind"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("unavailable").alias("status"))
    points = documented(spark, sf_dir)
    return roadbook.match_summary(days_, points, points.where("status = 'matched' and point_id % 2 = 0"))


def relation_issues(spark, sf_dir):
    """Planted faults: days and stages that don't point at each other, totals that aren't their parts', pauses out of order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    days_ = o.select(F.col("k").alias("day_id"), F.when(F.col("k") % 50 != 0, F.col("k") * 2).alias("stage_id"))
    stages_ = o.where("k % 70 <> 0").select((F.col("k") * 2).alias("stage_id"), F.when(F.col("k") % 30 == 0, F.col("k") + 1).otherwise(F.col("k")).alias("day_id"))
    sums = o.select("k", (F.col("k") % 1000).alias("moving"), (F.col("k") % 60).alias("pause"), (F.col("k") % 1000 + F.col("k") % 60 + F.when(F.col("k") % 90 == 0, 2).otherwise(1)).alias("total"))
    pauses = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_orderkey", (F.col("l_partkey") % 6).alias("order"))
    return quality.gathered(
        quality.mirror_issues(days_, "day_id", "stage_id", stages_, "stage_id", "day_id"),
        quality.sum_issues(sums, "k", "total", ("moving", "pause"), 1.0), quality.unique_issues(pauses, "id", "l_orderkey", "order"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        day_risk, track_metrics, track_summary_by_segment, track_cumulative, track_segment_gaps, track_backward_time, track_bounds, track_valid_coordinates, track_continuity,
        track_even_sample, track_chunks, track_local_slopes, track_slope_changes, weighted_distance, terrain_smoothed, terrain_slope_profile, terrain_display_profile, terrain_timing,
        terrain_pauses, terrain_extrema, terrain_grade_classes, climb_detection, climb_tiles, feature_spacing, speed_rules, break_budget, pause_allocation, clock_shifts,
        hourly_summary, daily_summary, nearest_hours, ride_association, off_day_association, hazard_findings, alert_groups, scenario_ranking, recommendations, weather_codes,
        display_modes, forecast_cache, nearest_segments, places_in_corridor, thinned_places, unique_places, similar_tracks, duplicate_files, trip_totals, trip_calendar, trip_fill_places,
        trip_progress, trip_highlight, trip_preferred, reference_points, stage_members, days_of_place, planned_files, upsert, unique_name_matches, enrichment_status, layer_counts,
        version_difference, validation_issues, schema_versions, expanded_boxes, name_keys, climb_landmarks, simplified_tracks, file_ordering, grouped_stops,
        summit_names, custom_pauses, stable_place_ids, endpoint_names, waypoint_visibility, documented_points, track_nearest_samples, automatic_pauses, documented_totals,
        day_slots, job_states, primary_alerts, retained_forecasts, live_progress, today_reference, stage_timing, pause_settings, placed_pauses, unused_places,
        paused_waypoints, slot_edits, time_markers, altitudes_between, route_fingerprints, column_keys, weather_labels, trip_periods, waypoint_order, point_roles, relation_issues,
        resolved_points, match_summaries, positions_at, downsampled_profiles, calendar_issues, corridor_places, corridor_features, nearest_named, largest_deviation,
    )
}
