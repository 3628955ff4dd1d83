"""Whole stages and trips on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from trailframe.operators import assembly, itinerary, rules, track
from trailframe.plans import itineraries

STAGES = "route_id long, start_name string, end_name string, pause_minutes int, mode string, departure string"
SERIES = "route_id long, seq int, distance_km double, latitude double, longitude double, elevation_m double"
POINTS = "route_id long, point_id long, kind string, name string, track_km double, latitude double, longitude double, elevation_m double"
CLIMBS = "route_id long, climb_id long, name string, start_km double, end_km double, gain_m double, average_grade double, end_m double, confirmed boolean"


def flat(spark, length=20.0, elevation=None):
    return spark.createDataFrame([(1, i, length * i / 40, 45 + i / 100, 6.0, elevation) for i in range(41)], SERIES)


def test_landmarks_go_to_climbs_once_and_ends_swallow_their_names(spark):
    points = [
        (1, 1, "mountain-pass", "Col Haut", 5.5, 45.1, 6.1, 900.0), (1, 2, "saddle", "COL-HAUT", 5.1, 45.1, 6.1, None), (1, 3, "city", "Âme", 1.0, 45.0, 6.0, None), (1, 4, "city", "ame", 2.5, 45.0, 6.0, None),
        (1, 5, "hamlet", "H", 3.0, 45.0, 6.0, 1.0), (1, 6, "village", None, 4.0, None, None, None), (1, 7, "town", "fin", 19.0, 45.0, 6.0, 3.0), (1, 8, "peak", "P", 3.0, 45.0, 6.0, 1.0), (1, 9, "town", "T", None, 45.0, 6.0, 1.0),
        (9, 10, "town", "T", 1.0, 45.0, 6.0, 1.0),
    ]
    climbs = [
        (1, 1, "col haut", 4.0, 5.0, 100.0, 5.0, 800.0, True), (1, 2, "Côl haut", 4.0, 6.0, 100.0, 5.0, 810.0, True), (1, 3, "col haut", 5.0, 5.9, 10.0, 1.0, 820.0, False), (1, 4, None, 8.0, 10.0, 130.0, 6.5, 830.0, False),
        (1, 5, None, 8.0, 12.0, 20.0, 0.5, 840.0, True), (7, 6, "x", 8.0, 12.0, 20.0, 0.5, 840.0, True),
    ]
    stages = spark.createDataFrame([(1, "Ame", "FIN", 0, None, "08:00"), (7, None, None, 0, None, "08:00")], STAGES)
    rows = itinerary.canonical_waypoints(stages, flat(spark, elevation=700.0), spark.createDataFrame(points, POINTS), spark.createDataFrame(climbs, CLIMBS)).orderBy("position").collect()
    got = [(r.waypoint_id, r.kind, r.importance, r.name, r.climb_id) for r in rows]
    assert got == [
        ("start", "start", "major", "Ame", None), ("place-4", "city", "major", "ame", None), ("place-6", "village", "secondary", None, None), ("place-2", "saddle", "major", "COL-HAUT", 3),
        ("place-1", "mountain-pass", "major", "Col Haut", 1), ("climb-2", "climb", "major", "Côl haut", 2), ("climb-4", "climb", "major", "Montée", 4), ("climb-5", "climb", "secondary", "Montée", 5), ("end", "end", "major", "FIN", None),
    ]
    by_id = {r.waypoint_id: r for r in rows}
    assert (by_id["place-1"].elevation_m, by_id["place-2"].elevation_m, by_id["climb-4"].elevation_m, by_id["end"].elevation_m) == (900.0, 700.0, 830.0, 700.0)
    assert abs(by_id["place-6"].latitude - 45.08) < 1e-9 and abs(by_id["climb-4"].latitude - 45.2) < 1e-9 and by_id["place-4"].latitude == 45.0
    strict = itinerary.canonical_waypoints(stages, flat(spark), spark.createDataFrame(points, POINTS), spark.createDataFrame(climbs, CLIMBS), F.lit(True)).where("kind = 'climb'")
    assert {r.waypoint_id: r.importance for r in strict.collect()} == {"climb-2": "major", "climb-4": "secondary", "climb-5": "secondary"}


def test_pauses_and_times(spark):
    points = spark.createDataFrame([(1, 1, "town", "T", 5.2, 45.0, 6.0, None), (1, 2, "city", "C", 10.9, 45.0, 6.0, None), (1, 3, "village", "V", 17.9, 45.0, 6.0, None)], POINTS)
    none = spark.createDataFrame([], CLIMBS)
    stage = lambda mode, minutes=40, departure="23:30": spark.createDataFrame([(1, None, None, minutes, mode, departure)], STAGES)
    rows = itinerary.stage_waypoints(stage(None), flat(spark), points, none).orderBy("position").collect()
    assert [(r.waypoint_id, r.pause_minutes, round(r.elapsed_minutes, 3), r.clock_time, r.visible) for r in rows] == [
        ("start", None, 0.0, "23:30", True), ("place-1", 10, 17.333, "23:47", True), ("place-2", 20, 46.333, "00:16 (+1 j)", True), ("pause-afternoon", 10, 80.0, "00:50 (+1 j)", True),
        ("place-3", None, 99.667, "01:10 (+1 j)", False), ("end", None, 106.667, "01:17 (+1 j)", True),
    ]
    own = spark.createDataFrame([(1, "place-2", 5), (1, "place-2", 7), (1, "gone", 9)], "route_id long, waypoint_id string, minutes int")
    rows = {r.waypoint_id: r for r in itinerary.stage_waypoints(stage("custom"), flat(spark), points, none, own).collect()}
    assert set(rows) == {"start", "place-1", "place-2", "place-3", "end"} and rows["place-2"].pause_minutes == 12 and round(rows["end"].elapsed_minutes, 3) == 78.667
    assert all(r.pause_minutes is None for r in itinerary.stage_waypoints(stage(None, None), flat(spark), points, none, own).collect())
    still = itinerary.stage_waypoints(stage(None), flat(spark, 0.0), points.limit(0), none).collect()
    assert {(r.waypoint_id, r.elapsed_minutes, r.clock_time) for r in still} == {("start", None, None), ("end", None, None)}
    assert itinerary.stage_waypoints(stage(None), flat(spark).limit(0), points, none).count() == 0


def test_assembled_documents_are_right(spark):
    parts = itineraries.trip_files(spark, "/root/testdata/sf0.001")
    few = parts[0].where("trip_id between 1 and 12").unionByName(parts[0].where("trip_id = 1").withColumn("trip_id", F.lit(-1).cast("long")))
    documents = assembly.assembled(few, *parts[1:])
    found = [(r.trip_id, r.path) for r in rules.document_issues(documents, rules.BUNDLE, "trip_id", "document").collect()]
    assert documents.count() == 13 and found == [(-1, "calendar.endDate")]  # a trip that begins, but has no day, can't end
    text = documents.where("trip_id = -1").select(F.to_json("document").alias("t")).first().t
    assert '"days":[]' in text and '"stages":[]' in text and '"status":"ready"' in text


def test_a_trip_is_gathered_once(spark):
    """Each collection of the document joined the files of all trips anew: more than thirty scans."""
    documents = assembly.assembled(*itineraries.trip_files(spark, "/root/testdata/sf0.001"))
    assert documents._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 5


def test_stages_are_built_in_order(spark):
    day = dt.date(2024, 2, 28)
    trips = spark.createDataFrame([(1, day), (2, None)], "trip_id long, start_date date")
    none = dict.fromkeys(("name", "distance_km", "gain_m", "loss_m", "min_m", "max_m", "moving_s", "pause_s", "total_s", "average_kph"))
    files = spark.createDataFrame([(1, 5, 30, "success"), (1, 2, 20, "partial"), (1, 5, 10, "error"), (2, 0, 40, "success"), (3, 0, 50, "success")], "trip_id long, position int, route_id long, status string")
    files = files.select("*", *[F.lit(None).cast("string" if c == "name" else "double").alias(c) for c in none])
    points = spark.createDataFrame([(30, 2, 7), (30, 1, 8)], "route_id long, ordinal int, point_id long")
    climbs = spark.createDataFrame([], "route_id long, ordinal int, climb_id long")
    rows = assembly.built_stages(files, trips, points, climbs).orderBy("trip_id", "index").collect()
    assert [(r.stage_id, r["index"], r.date, r.validation, r.end_name, r.point_ids, r.climb_ids) for r in rows] == [
        ("stage-20", 0, day, "needs-review", "Arrivée étape 1", [], []), ("stage-10", 1, dt.date(2024, 2, 29), "needs-review", "Arrivée étape 2", [], []),
        ("stage-30", 2, dt.date(2024, 3, 1), "valid", "Arrivée étape 3", [8, 7], []), ("stage-40", 0, None, "valid", "Arrivée étape 1", [], []),
    ]


def test_files_of_a_trip_are_one_profile(spark):
    points = [(1, 1, 0, i, 45 + i * 0.001, 6.0, 100.0 + i if i != 1 else None) for i in range(3)] + [(1, 1, 1, i, 45.0025 + i * 0.001, 6.0, 500.0 - i) for i in range(2)] + [(1, 2, 0, 0, 45.01, 6.0, None), (2, 1, 0, 0, 0.0, 0.0, None), (2, 3, 0, 0, 0.0, 0.0, None)]
    rows = track.joined_profile(spark.createDataFrame(points, "trip_id long, file_number int, segment_index int, seq int, latitude double, longitude double, elevation_m double"))
    step = 0.1111950802
    got = [(r.distance_km, r.gain_m, r.loss_m, r.gap_km) for r in rows.where("trip_id = 1").orderBy("file_number", "segment_index", "seq").collect()]
    want = [(0, 0, 0, None), (step, 0, 0, None), (2 * step, 2, 0, None), (2 * step, 2, 0, step / 2), (3 * step, 2, 1, None), (3 * step, 2, 1, 6.5 * step)]
    assert len(got) == len(want) and all((a is b) if b is None else abs(a - b) < 1e-6 for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))
    told = {r.trip_id: (r.files, r.segments, r.points, round(r.largest_gap_km / step, 3), r.continuous) for r in track.joined_summary(rows).collect()}
    assert told == {1: (2, 3, 6, 6.5, False), 2: (2, 2, 2, 0.0, False)}
    assert [r.continuous for r in track.joined_summary(rows.where("trip_id = 1"), 1.0).collect()] == [True]
    assert track.joined_summary(rows.limit(0)).count() == 0
