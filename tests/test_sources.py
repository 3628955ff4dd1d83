"""Readers, the versioned store, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from trailframe.operators import track
from trailframe.sources import documents, gpx
from trailframe.streaming import fixes

GOOD = """<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><metadata><name>T</name></metadata>
<wpt lat="45.0" lon="6.0"><ele>800</ele><name>Col A</name></wpt><wpt lat="99" lon="6"><name>bad</name></wpt>
<trk><trkseg><trkpt lat="45.0" lon="6.0"><ele>800</ele></trkpt><trkpt lat="45.01" lon="6.0"><ele>810</ele></trkpt></trkseg>
<trkseg><trkpt lat="45.02" lon="6.0"/><trkpt lat="x" lon="6.0"/><trkpt lat="45.03" lon="6.0"><ele>805</ele></trkpt></trkseg></trk></gpx>"""
PREFIXED = """<g:gpx xmlns:g="http://www.topografix.com/GPX/1/0"><g:rte><g:rtept lat="1" lon="2"/><g:rtept lat="1.5" lon="2"/></g:rte></g:gpx>"""


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("gpx")
    for name, text in {"01-good.gpx": GOOD, "2_route.gpx": PREFIXED, "broken.gpx": "<gpx><trk>", "note.txt": "no", "empty.gpx": "<gpx></gpx>"}.items():
        (folder / name).write_text(text)
    return gpx.read_files(spark, str(folder))


def test_points_and_segments(files):
    rows = gpx.track_points(files).orderBy("file_name", "seq").collect()
    assert [(r.segment_index, r.seq, r.valid) for r in rows if r.file_name == "01-good.gpx"] == [(0, 0, True), (0, 1, True), (1, 2, True), (1, 3, False), (1, 4, True)]
    assert [(r.latitude, r.longitude) for r in rows if r.file_name == "2_route.gpx"] == [(1.0, 2.0), (1.5, 2.0)]
    assert [r.name for r in gpx.named_points(files).collect()] == ["Col A"]


def test_issues(files, spark):
    issues = {(r.file_name, r.code) for r in gpx.file_issues(files).collect()}
    assert ("01-good.gpx", "invalid-coordinates") in issues and ("empty.gpx", "no-points") in issues
    assert {c for n, c in issues if n == "broken.gpx"} and not any(n == "2_route.gpx" for n, _ in issues)
    odd = spark.createDataFrame([("a.kml", 3), ("", 3), ("b.GPX", 0), ("c.gpx", 5)], "file_name string, size long")
    assert {(r.file_name, r.code) for r in gpx.admission_issues(odd).collect()} == {("a.kml", "wrong-extension"), ("", "missing-name"), ("b.GPX", "empty-file")}
    assert [r[0] for r in odd.select(gpx.file_number(F.lit("etape 07 - x.gpx"))).collect()][0] == 7


def test_gaps_count_only_in_flattened_tracks(files):
    points = gpx.track_points(files).where("valid and file_name = '01-good.gpx'").withColumn("route_id", F.lit(1))
    flat = track.metrics(points, "route_id").first()
    apart = track.summary_by_segment(points).first()
    assert flat.distance_km > 3.3 and 2.2 < apart.distance_km < 2.3
    assert flat.gain_m == 10 and flat.loss_m == 5 and apart.loss_m is None or apart.loss_m == 0


def test_forecast_rows(spark):
    ok = {"location_id": 1, "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "precipitation": [0.1, None]}}
    short = {"location_id": 2, "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "precipitation": [0.1]}}
    back = {"location_id": 3, "hourly": {"time": ["2024-01-01T01:00", "2024-01-01T00:00"]}}
    df = spark.createDataFrame([("r", json.dumps([ok, short, back])), ("e", "[]")], "request string, json string")
    rows = documents.forecast_rows(df).orderBy("time").collect()
    assert [(r.location_id, r.precipitation) for r in rows] == [(1, 0.1), (1, None)]
    status = {r.request: (r.status, r.dates) for r in documents.forecast_status(df, F.lit(3)).collect()}
    assert status["r"] == ("partial", ["2024-01-01"]) and status["e"][0] == "error"


def test_features(spark):
    doc = {"features": [{"id": "1", "geometry": {"type": "Point", "coordinates": [6.0, 45.0]}, "properties": {"name": "A", "ele": "1 234,5 m", "amenity": "drinking_water"}}, {"id": "2", "geometry": {"type": "LineString", "coordinates": []}, "properties": {}}]}
    row = documents.features(spark.createDataFrame([(json.dumps(doc),)], "json string"))
    got = row.withColumn("category", documents.place_category(F.col("tags"))).collect()
    assert [(r.id, r.elevation_m, r.category) for r in got] == [("1", 1234.5, "water")]


def test_records_keep_their_order(spark):
    df = spark.createDataFrame([("t", ["c", "a", "b"]), ("u", ["z"])], "trip_id string, ids array<string>")
    back = documents.collect_records(documents.explode_records(df, "trip_id", "ids").repartition(3), "trip_id", "ids")
    assert {r.trip_id: r.ids for r in back.collect()} == {"t": ["c", "a", "b"], "u": ["z"]}


def test_versions_are_whole(spark, tmp_path):
    root = str(tmp_path / "store")
    days = spark.createDataFrame([(1, "a")], "day int, name string")
    documents.save_version(spark, root, "t1", {"days": days}, 1)
    documents.save_version(spark, root, "t1", {"days": days.withColumn("name", F.lit("b"))}, 2)
    days.write.parquet(f"{root}/data/trip=t1/version=3/days")  # left by a writer that was lost
    assert documents.load_table(spark, root, "t1", "days").first().name == "b"
    with pytest.raises(ValueError):
        documents.load_table(spark, root, "t2", "days")


def test_caches(spark):
    points = spark.createDataFrame([(1, 45.0, 6.0), (2, 46.0, 6.0)], "point_id int, latitude double, longitude double")
    cache = spark.createDataFrame([(45.0001, 6.0, "near", 1), (45.0005, 6.0, "far", 2), (47.0, 6.0, "no", 3)], "latitude double, longitude double, answer string, fetched_at int")
    assert [(r.point_id, r.answer) for r in documents.nearest_cached(points, cache, 100.0).collect()] == [(1, "near")]
    held = spark.createDataFrame([("o", str(i), i, "x" * 10) for i in range(30)], "owner string, request string, fetched_at int, payload string")
    assert documents.trimmed_cache(held).count() == 24 and documents.trimmed_cache(held, 24, 55).count() == 5


def test_sessions_on_a_stream_equal_the_table(spark, tmp_path):
    rows = spark.range(40).selectExpr("id % 3 as rider_id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 7 + if(id > 20, 60, 0) as int)) as ts", "cast(id as double) as speed_kph")
    rows.write.parquet(f"{tmp_path}/in")
    want = sorted(map(tuple, fixes.sessions(rows).collect()))
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = fixes.sessions(stream).writeStream.outputMode("complete").format("memory").queryName("rides").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("rides").collect())) == want and len(want) > 3
