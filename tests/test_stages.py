"""Stages, pauses, forecast rules and places along routes on small tables."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from trailframe.functions import clock, weather
from trailframe.operators import forecast, quality, spatial, stages, track, waypoints
from trailframe.sources import documents

NTZ = "timestamp_ntz"


def at(text):
    return F.lit(text).cast(NTZ)


def test_display_mode_asks_for_coverage_before_the_bands(spark):
    days = ["2031-05-09", "2031-05-10", "2031-05-11", "2031-05-12", "2031-05-13", "2031-05-17", "2031-05-18"]
    df = spark.createDataFrame([(d, lo, hi) for d in days for lo, hi in (("2031-05-01", "2031-05-31"), (None, None))], "d string, lo string, hi string").selectExpr("cast(d as date) d", "cast(lo as date) lo", "cast(hi as date) hi")
    got = [r.m for r in df.select("d", "lo", weather.display_mode(F.col("d"), F.lit("2031-05-10").cast("date"), F.col("lo"), F.col("hi")).alias("m")).orderBy("lo", "d").collect()]
    assert got == ["past", "live"] + ["today-reference"] * 5 + ["past", "live", "operational", "operational", "planning", "planning", "trend"]


HOURS = "location_id int, time string, apparent_c double, precipitation_mm double, precipitation_pct double, snowfall_cm double, weather_code int, wind_kph double, gust_kph double, visibility_m double, freezing_m double"
STOPS = "point_id long, location_id int, day_id int, date string, eta string, elevation_m double, kind string, strategic boolean"


def tables(spark, year, gust):
    hours = [(1, f"{year}-06-0{d} {h:02d}:00:00", 15.0, 0.0, 0.0, 0.0, 0, 5.0, gust(d, h), 9000.0, 4000.0) for d in (1, 2) for h in range(24)]
    points = [(1, 1, 7, f"{year}-06-01", f"{year}-06-01 01:30:00", 500.0, "start", False), (2, 1, 7, f"{year}-06-01", f"{year}-06-01 09:00:00", 500.0, "end", False)]
    h = spark.createDataFrame(hours, HOURS).withColumn("time", F.col("time").cast(NTZ))
    return spark.createDataFrame(points, STOPS).withColumn("eta", F.col("eta").cast(NTZ)).withColumn("date", F.col("date").cast("date")), h


@pytest.mark.parametrize("year", [2019, 2024, 2033])
def test_shifts_before_the_own_day_are_incoherent_in_any_year(spark, year):
    points, hours = tables(spark, year, lambda d, h: 80.0 if h in (9, 10) else 10.0)
    ranking = forecast.ranked(forecast.scenario_summary(forecast.scenarios(points, hours)))
    assert {r.offset: r.coherent for r in ranking.collect()} == {-120: False, -60: True, 0: True, 60: True, 120: True}

    def advice(mode="operational", departed=False, age=1.0):
        context = spark.createDataFrame([(7, mode, departed, age)], "day_id int, mode string, departed boolean, age_hours double")
        return tuple(forecast.recommendation(ranking, context).first())

    assert advice() == (7, "recommended-change", -60)
    assert advice("planning")[1] == advice("live", True)[1] == advice(None)[1] == "not-applicable"
    assert advice("live")[1] == "recommended-change" and advice(age=6.5) == (7, "insufficient-data", None) and advice(age=None)[1] == "recommended-change"
    poor = forecast.ranked(forecast.scenario_summary(forecast.scenarios(points, hours.where("hour(time) < 8"))))
    context = spark.createDataFrame([(7, "operational", False, 1.0)], "day_id int, mode string, departed boolean, age_hours double")
    assert forecast.recommendation(poor, context).first().status == "insufficient-data"


def test_alerts_on_the_data_itself(spark):
    points, hours = tables(spark, 2025, lambda d, h: 10.0)
    near = forecast.nearest_hour(points, hours).withColumn("upcoming", F.lit(True))
    fetched = spark.createDataFrame([(7, "2025-06-01 00:00:00")], "day_id int, f string").select("day_id", F.col("f").cast(NTZ).alias("fetched_at"))
    assert forecast.day_risk(near, fetched, at("2025-06-01 06:00:00")).first().level == "green"
    assert forecast.day_risk(near, fetched, at("2025-06-01 06:01:00")).first().level == "unknown"
    rows = spark.createDataFrame([(1, 0.79, None), (2, None, "2025-06-01 00:00:00"), (3, 0.8, None)], "day_id int, coverage double, f string").withColumn("fetched_at", F.col("f").cast(NTZ))
    assert sorted((r.day_id, r.risk) for r in forecast.meta_alerts(rows, at("2025-06-02 00:00:00")).collect()) == [(1, "forecast-coverage"), (2, "stale-data")]


def test_hours_are_bucketed_without_a_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
        points, hours = tables(spark, 2024, lambda d, h: 10.0)
        summer = points.withColumn("eta", at("2024-03-31 02:20:00")).limit(1)
        late = hours.limit(2).withColumn("time", F.when(F.hour("time") == 0, at("2024-03-31 02:00:00")).otherwise(at("2024-03-31 03:00:00")))
        assert forecast.nearest_hour(summer, late).first().forecast_time == datetime.datetime(2024, 3, 31, 2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_live_progress_and_clocks(spark):
    points, _ = tables(spark, 2024, lambda d, h: 10.0)
    got = [r.state for r in forecast.live_progress(points, at("2024-06-01 01:30:00")).orderBy("position").collect()]
    assert got == ["past", "next"]
    row = spark.sql("select timestamp'2024-07-01 23:30:00Z' as t").select(clock.date_in_zone(F.col("t"), "Europe/Paris").alias("d"), clock.local_now(F.col("t"), "Europe/Paris").alias("n")).first()
    assert (str(row.d), row.n) == ("2024-07-02", "2024-07-02T01:30")


def test_place_categories_names_and_tags(spark):
    tags = [{"amenity": "drinking_water"}, {"amenity": "toilets"}, {"amenity": "bicycle_repair_station"}, {"shop": "bicycle"}, {"amenity": "shelter"}, {"shop": "bakery"}, {"amenity": "fast_food"}, {"shop": "sports"}, {"shop": "deli"}, {"amenity": "cafe"}]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, tags map<string,string>")
    got = [r.c for r in df.orderBy("i").select(documents.place_category(F.col("tags")).alias("c")).collect()]
    assert got == ["water", "toilet", "bike-service", "bike-service", "shelter", "bakery", "fast-food", "sports", "supermarket", None]
    one = spark.createDataFrame([({"name": " ", "brand": " B ", "shop": " x", "phone": " ", "other": "y"},)], "tags map<string,string>")
    row = one.select(documents.place_name(F.col("tags"), "fr").alias("n"), documents.useful_tags(F.col("tags")).alias("t")).first()
    assert row.n == "B" and row.t == {"brand": "B", "shop": "x"}


def test_stage_timing(spark):
    df = spark.createDataFrame([(1, 36.0, 0.0, None, 30), (2, 36.0, 900.0, 200.0, None), (3, 0.0, 0.0, None, 0)], "route_id long, total_km double, gain_m double, moving_minutes double, break_minutes int")
    got = {r.route_id: r for r in stages.stage_timing(df).collect()}
    assert (got[1].moving_s, got[1].pause_s, got[1].total_s, got[1].average_kph) == (7200, 1800, 9000, 18.0)
    hours = 200 / 60
    budget = 5 * math.floor(hours * (3.6 + 1.295 * hours) * (1 + 20 / 60 * 0.8) / 5 + 0.5)
    assert (got[2].moving_s, got[2].break_minutes) == (12000, budget) and (got[3].total_s, got[3].average_kph) == (0, None)


def test_pauses_take_the_best_free_place(spark):
    ideal = spark.createDataFrame([(1, 0, 25.0, 10), (1, 1, 50.0, 20), (1, 2, 75.0, 10), (2, 0, 1.0, 5)], "route_id long, position int, km double, minutes int")
    points = spark.createDataFrame(
        [(1, 1, "village", 25.0), (1, 2, "city", 36.0), (1, 3, "town", 40.0), (1, 4, "town", 52.0), (1, 5, "start", 75.0), (1, 6, "city", 5.0)], "route_id long, waypoint_id long, kind string, km double"
    )
    totals = spark.createDataFrame([(1, 100.0), (2, 100.0)], "route_id long, total_km double")
    placed = stages.placed_pauses(ideal, points, totals)
    assert sorted(tuple(r) for r in placed.select("route_id", "position", "km", "minutes", "waypoint_id").collect()) == [(1, 0, 36.0, 10, 2), (1, 1, 52.0, 20, 4), (1, 2, 75.0, 10, None), (2, 0, 8.0, 5, None)]
    places = points.select("route_id", F.col("waypoint_id").alias("place_id"), "km")
    taken = stages.unused_places(ideal.select("route_id", "position", (F.lit(0.0) + F.col("km") * 0 + 38).alias("km")), places).collect()
    assert sorted((r.position, r.place_id) for r in taken) == [(0, 2), (1, 3), (2, 1)]


def test_markers_skip_seeds_and_values_between(spark):
    line = [(1, i, float(i), float(i), 45.0 + i / 100, 6.0, e) for i, e in enumerate([0.0, 10.0, None, 5.0, 25.0])]
    df = spark.createDataFrame(line, "route_id long, seq long, distance_km double, weighted_km double, latitude double, longitude double, elevation_m double")
    seeds = spark.createDataFrame([(1, 3.0)], "route_id long, weighted_km double")
    got = stages.time_markers(df, seeds, minutes=5.0).orderBy("marker").collect()
    assert [(r.marker, r.weighted_km) for r in got] == [(1, 1.5)] and got[0].latitude == pytest.approx(45.015)
    spans = spark.createDataFrame([(1, 0, 0.5, 3.5), (1, 1, 2.0, 2.5)], "route_id long, k int, low_km double, high_km double")
    rows = {r.k: (r.lowest_m, r.highest_m, r.gain_m) for r in stages.between(df, spans).collect()}
    assert rows[0] == pytest.approx((5.0, 15.0, 15.0)) and rows[1] == pytest.approx((6.25, 7.5, 0.0))


def test_downsampling_keeps_ends_and_jumps(spark):
    e = [0.0, 1.0, 50.0, 2.0, 3.0, -40.0, 4.0, 5.0]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(e)] + [(2, 0, 1.0)], "route_id long, k long, elevation_m double")
    got = sorted((r.route_id, r.k) for r in stages.downsampled(df, 4).collect())
    assert got == [(1, 0), (1, 2), (1, 5), (1, 7), (2, 0)]


def test_slots(spark):
    df = spark.createDataFrame([(["ride", "off", "ride"],)], "s array<string>")
    row = df.select(
        stages.inserted(F.col("s"), F.lit(-1), F.lit("off")), stages.inserted(F.col("s"), F.lit(9), F.lit("off")), stages.removed(F.col("s"), F.lit(1)), stages.removed(F.col("s"), F.lit(0)),
        stages.removed(F.col("s"), F.lit(7)), stages.moved(F.col("s"), F.lit(1), F.lit(-1)), stages.moved(F.col("s"), F.lit(0), F.lit(-1)),
    ).first()
    assert list(row) == [["off", "ride", "off", "ride"], ["ride", "off", "ride", "off"], ["ride", "ride"], None, ["ride", "off", "ride"], ["off", "ride", "ride"], ["ride", "off", "ride"]]


def test_pairs_are_found_far_north(spark):
    line = spark.createDataFrame([(1, 0, 85.0, 20.0), (1, 1, 85.0, 21.0)], "route_id long, seq long, latitude double, longitude double")
    places = spark.createDataFrame([(1, 85.0004, 20.5), (2, 85.01, 20.5), (3, 85.0, 21.002)], "place_id long, latitude double, longitude double")
    assert sorted(r.place_id for r in spatial.nearest_segment(places, line, 100.0).collect()) == [1, 3]


def test_corridor_rules(spark):
    schema = "route_id long, place_id long, source_id string, category string, name string, repair boolean, latitude double, longitude double, lateral_m double"
    rows = [
        (1, 1, "a", "bakery", "Pain", False, 45.0, 6.0, 10.0), (1, 2, "b", "bakery", "pain", False, 45.0003, 6.0, 20.0), (1, 3, "c", "bakery", "Pain", False, 45.001, 6.0, 30.0),
        (1, 4, "d", "bakery", None, False, 45.0, 6.0, 5.0), (1, 5, "e", "water", None, False, 45.0, 6.0, 5.0), (1, 6, "f", "water", None, False, 45.00003, 6.0, 6.0),
        (1, 7, "g", "water", None, False, 45.0001, 6.0, 7.0), (1, 8, "h", "bike-service", None, True, 45.0, 6.0, 8.0), (1, 9, "i", "bike-service", None, False, 45.0, 6.0, 8.0), (1, 10, "a", "bakery", "Pain", False, 45.1, 6.0, 9.0),
        (1, 11, "j", "water", None, False, 45.2, 6.0, 251.0),
    ]
    df = spark.createDataFrame(rows, schema)
    got = sorted(r.place_id for r in spatial.corridor_places(df, waypoints.name_key(F.col("name"))).collect())
    assert got == [2, 3, 5, 7, 8, 10]


def test_chunks_restart_where_they_end(spark):
    d = [0.0, 300.0, 720.0, 800.0, 1500.0, 1501.0]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(d)], "route_id long, seq long, distance_m double")
    assert [r.chunk for r in track.chunks(df, 700.0).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 2]


def test_relations(spark):
    a = spark.createDataFrame([(1, 10), (2, 20), (3, None), (4, 40)], "day long, stage long")
    b = spark.createDataFrame([(10, 1), (20, 9), (30, 3)], "stage long, day long")
    assert sorted(r.id for r in quality.mirror_issues(a, "day", "stage", b, "stage", "day").collect()) == ["2", "4"]
