"""Map exports, accommodations, short names, structure of track files, and the documented points' summary."""

import json

from pyspark.sql import functions as F

from trailframe.operators import roadbook
from trailframe.sources import gpx, places

KML = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>m</name>
<Folder><name> Water  points </name><Placemark><name>Fountain</name><description>&lt;b&gt;fountain&lt;/b&gt;&lt;br&gt;Open all year&lt;br&gt;open ALL year&lt;script&gt;x()&lt;/script&gt;</description>
<Point><coordinates> 6.1,45.2,900 </coordinates></Point></Placemark><Placemark><name></name><Point><coordinates>7,46</coordinates></Point></Placemark></Folder>
<Folder><name>Hidden</name><Placemark><name>h</name><Point><coordinates>1,2</coordinates></Point></Placemark></Folder>
<Placemark><name>loose</name><Point><coordinates>5.5,44.5,0</coordinates></Point></Placemark><Placemark><name>far</name><Point><coordinates>5,95</coordinates></Point></Placemark>
<Placemark><name>line</name><LineString><coordinates>1,2 3,4</coordinates></LineString></Placemark></Document></kml>"""


def test_kml_points(spark):
    df = spark.createDataFrame([("a.kml", KML), ("b.kml", "<kml/>")], "file_name string, xml string")
    got = sorted((r.layer, r.name, r.description, r.latitude, r.longitude, r.elevation_m) for r in places.kml_points(df, ("hidden",)).collect())
    assert got == [("Sans calque", "loose", None, 44.5, 5.5, 0.0), ("Water points", "Fountain", "Open all year", 45.2, 6.1, 900.0), ("Water points", "Water points", None, 46.0, 7.0, None)]


def test_accommodations(spark):
    doc = {"version": 1, "tripId": "t", "accommodations": [{"id": "h", "name": "H", "type": "hotel", "address": "x", "dayIds": ["J1", "J2"]}]}
    df = spark.createDataFrame([(json.dumps(doc),), (json.dumps(doc | {"version": 2}),), ("no",)], "json string")
    assert sorted((r.id, r.day_id) for r in places.accommodations(df).collect()) == [("h", "J1"), ("h", "J2")]


def test_short_names(spark):
    rows = [({"town": " T ", "road": "R"}, None, None), ({"road": "R", "country": "C"}, None, None), ({"road": "C", "county": "C"}, None, None), ({"county": "C"}, "N", None), ({"county": "C"}, " ", None), ({}, None, "a, ,b,c"), ({}, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a map<string,string>, n string, d string")
    got = [r.s for r in df.orderBy("i").select(places.short_place_name(F.col("a"), F.col("n"), F.col("d")).alias("s")).collect()]
    assert got == ["T", "R, C", "C", "N", "C", "a, b", None]


def test_structure_counts(spark):
    xml = "<gpx><metadata><name>m</name></metadata><wpt lat='1' lon='2'><x:name>a</x:name><sym/></wpt><wpt/><rte><rtept/></rte><names/></gpx>"
    row = gpx.structure_counts(spark.createDataFrame([("f", xml)], "file_name string, xml string")).first()
    assert (row.wpt_count, row.rtept_count, row.name_count, row.desc_count, row.sym_count, row.extensions_count) == (2, 1, 2, 0, 1, 0)


def test_summary_of_documented_points(spark):
    points = spark.createDataFrame([(1, 1, "a", "matched", "pause"), (1, 2, "b", "unmatched", "poi"), (1, 3, "c", "matched", "poi"), (1, 4, "d", "needs-review", "poi")], "trip_id int, point_id int, name string, status string, kind string")
    entries = spark.createDataFrame([(3, "excluded", "no", "C!")], "point_id int, resolution string, justification string, display_name string")
    rows = roadbook.resolved(points, entries, spark.createDataFrame([(2,)], "point_id int"))
    assert sorted((r.point_id, r.name, r.resolution, r.justification) for r in rows.collect()) == [(1, "a", "matched", None), (3, "C!", "excluded", "no"), (4, "d", "user-decision-required", None)]
    days = spark.createDataFrame([(1, "ride", "ready"), (1, "off", None), (2, "ride", "unavailable")], "trip_id int, kind string, status string")
    got = {r.trip_id: r for r in roadbook.match_summary(days, rows, rows.limit(0)).collect()}
    assert (got[1].days, got[1].ready, got[1].points, got[1].status_matched, got[1].resolution_excluded, got[1].matched_pauses, got[2].unavailable, got[2].points) == (2, 1, 3, 2, 1, 1, 1, 0)
    assert roadbook.summary_issues(roadbook.match_summary(days, rows, rows)).count() == 0
    odd = roadbook.match_summary(days, rows.withColumn("status", F.lit("?")), rows)
    assert [tuple(r) for r in roadbook.summary_issues(odd).collect()] == [("1", "status-count")]
