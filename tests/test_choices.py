"""Choices among places, pauses, samples and alerts on small tables."""

from pyspark.sql import functions as F

from trailframe.functions import geo, terrain
from trailframe.operators import forecast, track, trip, waypoints


def test_summits_take_passes_first(spark):
    summits = spark.createDataFrame([(1, 45.0, 6.0, 1000.0), (2, 46.0, 6.0, None), (3, 47.0, 6.0, 500.0)], "climb_id long, latitude double, longitude double, elevation_m double")
    rows = [
        (10, "peak", "near", 45.0, 6.0, 1000.0), (11, "saddle", "s", 45.001, 6.0, None), (12, "mountain-pass", "far", 45.0024, 6.0, 1000.0), (13, "mountain-pass", "high", 45.0, 6.0, 1200.0),
        (20, "peak", "bare", 46.0005, 6.0, None), (21, "peak", "bare and near", 46.0003, 6.0, None), (30, "hamlet", "other", 47.0, 6.0, 500.0),
    ]
    candidates = spark.createDataFrame(rows, "candidate_id long, kind string, name string, latitude double, longitude double, elevation_m double")
    got = {r.climb_id: r.candidate_id for r in waypoints.summit_names(summits, candidates).collect()}
    assert got == {1: 11, 2: 21}  # the pass is 267 m away, the other one 200 m too high
    assert waypoints.summit_names(summits, candidates.limit(0)).count() == 0


def test_samples_are_the_nearest_points(spark):
    at = [0.0, 0.2, 0.45, 0.6, 1.0, 1.9, 2.0]
    df = spark.createDataFrame([(1, i, d) for i, d in enumerate(at)] + [(2, 0, 0.0)], "route_id long, seq long, distance_km double")
    got = sorted((r.route_id, r.seq) for r in track.nearest_samples(df).collect())
    want = {0, len(at) - 1} | {min(range(len(at)), key=lambda i: abs(at[i] - k * 0.5)) for k in (1, 2, 3)}
    assert got == [(1, i) for i in sorted(want)] + [(2, 0)]


def test_pauses(spark):
    pauses = spark.createDataFrame([(1, 5, 70, 2, 10, True), (1, 5, 71, 1, 15, True), (1, 6, 72, 0, 5, False), (1, 9, 73, 0, 5, True), (2, 5, 74, 0, 0, True)], "day_id long, place_id long, pause_id long, order int, minutes long, active boolean")
    places = spark.createDataFrame([(5,), (6,)], "place_id long")
    assert [tuple(r) for r in waypoints.custom_pauses(pauses, places).collect()] == [(1, 5, 71, 25)]
    rides = spark.createDataFrame([(1, 80.0, 61), (2, 0.0, 60), (3, 50.0, 0), (4, 40.0, 1)], "day_id long, total_km double, break_minutes long")
    got = sorted((r.day_id, r.km, r.minutes) for r in trip.automatic_pauses(rides).collect())
    assert got == [(1, 20.0, 15), (1, 40.0, 31), (1, 60.0, 15), (4, 20.0, 1)]


def test_states_and_sums(spark):
    log = spark.createDataFrame([(1, 1, "pending", None), (1, 2, "parsing", 3), (1, 3, "ready", None), (2, 1, "pending", None)], "job long, at int, status string, files int")
    assert sorted(tuple(r) for r in trip.job_states(log, "job", ("at",), "status", "files").collect()) == [(1, "ready", 3, 3), (2, "pending", None, 1)]
    days = spark.createDataFrame([(1, 1.0, None), (1, 2.0, 5.0)], "trip_id long, km double, m double")
    assert [tuple(r) for r in trip.all_or_nothing(days, "trip_id", "km", "m").collect()] == [(1, 3.0, None)]
    fetched = spark.createDataFrame([("a", 1, False, 1), ("a", 2, True, 2), ("a", 3, False, 3)], "place string, at int, good boolean, payload int")
    got = sorted((r["at"], r.payload, r.retained) for r in forecast.retained(fetched, "place", ("at",), F.col("good"), "payload").collect())
    assert got == [(1, None, False), (2, 2, False), (3, 2, True)]


def test_primary_alert(spark):
    points = spark.createDataFrame([(1, 1, "col", 900.0), (1, 2, "col", 2000.0), (1, 3, "end", 2500.0)], "day_id int, point_id long, kind string, elevation_m double")
    rows = spark.createDataFrame([(1, 1, "wind", "orange", 1, 1), (1, 2, "wind", "orange", 5, 2), (1, 3, "snow", "unknown", 0, 3), (2, 9, "cold", "orange", 4, 1), (2, 8, "cold", "red", 6, 2)], "day_id int, point_id long, risk string, level string, eta int, ord int")
    assert sorted((r.day_id, r.point_id) for r in forecast.primary_alerts(rows, points).collect()) == [(1, 2), (2, 8)]


def test_small_rules(spark):
    df = spark.createDataFrame([("1 234,5 m",), ("about 5",), (".5",), (None,), ("-12",), ("",)], "t string")
    assert [r[0] for r in df.select(geo.leading_number(F.col("t"))).collect()] == [1234.5, None, 0.5, None, -12.0, None]
    one = spark.range(1)
    seen = lambda kind, importance, paused, small=False: one.select(terrain.waypoint_visible(F.lit(kind), F.lit(importance), F.lit(paused), small)).first()[0]
    assert [seen("town", "major", False), seen("town", "major", True), seen("climb", "secondary", False), seen("climb", "secondary", False, True), seen("climb", "major", False)] == [False, True, False, True, True]
    twice = spark.createDataFrame([(1, "l", "N", 45.0, 6.0), (2, "l", "n", 45.0, 6.0), (3, "l", None, 45.0, 6.0)], "place_id long, layer string, name string, latitude double, longitude double")
    ids = {r.place_id: r.stable_id for r in waypoints.stable_ids(twice).collect()}
    assert ids[2] == ids[1] + "-2" and ids[3] != ids[1]
    points = spark.createDataFrame([(1, "town", "Èze", 1.5), (1, "town", "eze", 2.5), (1, "saddle", "Eze", 0.1), (1, "village", None, 0.1), (1, "village", "End", 9.0)], "route_id long, kind string, name string, track_km double")
    routes = spark.createDataFrame([(1, "EZE", "end", 10.0)], "route_id long, start_name string, end_name string, total_km double")
    assert sorted(r.track_km for r in waypoints.without_endpoint_names(points, routes).collect()) == [0.1, 0.1, 2.5]
