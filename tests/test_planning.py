"""Points on tracks, replayed placements, edits, timelines, loops, packages, payloads and weather days by hand."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from trailframe.operators import edits, packages, projection, rules, timeline, waypoints, weather_days
from trailframe.plans import documents
from trailframe.sources import payloads

DEGREE = math.radians(1) * 6371.0088


@pytest.fixture(scope="module")
def track(spark):
    """A segment along the equator, one single point, and a segment back over the first one."""
    rows = [(1, 0, i, 0.0, i * 0.01, 100.0 + i if i != 2 else None) for i in range(4)] + [(1, 1, 0, 0.5, 0.5, 7.0)] + [(1, 2, i, 0.0, 0.03 - i * 0.01, 50.0) for i in range(4)]
    return projection.vertices(spark.createDataFrame(rows, "route_id long, segment_index int, point_index int, latitude double, longitude double, elevation_m double"))


def test_vertices_leave_gaps_out(track):
    km = {(r.segment_index, r.point_index): r.track_km for r in track.collect()}
    assert km[0, 3] == pytest.approx(0.03 * DEGREE) and km[1, 0] == km[0, 3] == km[2, 0] and km[2, 3] == pytest.approx(0.06 * DEGREE)


def test_equal_laterals_go_to_the_smaller_track_distance(spark, track):
    points = [(1, 1, 0.001, 0.025), (1, 2, 0.5, 0.5), (1, 3, 0.5, 0.51), (1, 4, 95.0, 0.0), (1, 5, 0.001, 0.015)]
    got = {r.point_id: r for r in projection.projected(spark.createDataFrame(points, "route_id long, point_id long, latitude double, longitude double"), track).collect()}
    assert sorted(got) == [1, 2, 3, 5]
    assert (got[1].segment_index, got[1].point_index, got[1].next_point_index) == (0, 2, 3) and got[1].share == pytest.approx(0.5) and got[1].track_elevation_m == 103.0 and got[1].status == "matched"
    assert (got[2].segment_index, got[2].distance_m, got[2].next_point_index) == (1, 0.0, 0) and got[3].status == "unmatched"
    assert got[5].track_elevation_m == 101.0  # the far end has none


def test_replay_names_the_tolerance(spark, track):
    half = (0.0, 0.005, 100.5, 0.005 * DEGREE)
    base = (0, 0, 1, 0.5, *half, 0.001, 0.005, 0.001 * DEGREE * 1000)
    names = "segment_index point_index next_point_index share latitude longitude elevation_m approved_km anchor_latitude anchor_longitude anchor_m".split()
    cases = {
        1: {}, 2: {"latitude": 0.0002}, 3: {"approved_km": half[3] + 0.016}, 4: {"elevation_m": 106.0}, 5: {"anchor_m": 90.0}, 6: {"next_point_index": 2}, 7: {"segment_index": 9}, 8: {"share": 1.5},
        9: {"latitude": 0.0002, "elevation_m": 90.0}, 10: {"next_point_index": 0, "share": 0.0, "longitude": 0.0, "elevation_m": 100.0, "approved_km": 0.0, "anchor_longitude": 0.0},
    }
    rows = [(1, i, 2, *{**dict(zip(names, base, strict=True)), **change}.values()) for i, change in cases.items()]
    rows.append((1, 1, 1, *base[:1], 7, *base[2:]))  # an older version that is lost
    schema = "route_id long, point_id long, version int, segment_index int, point_index int, next_point_index int, share double, latitude double, longitude double, elevation_m double, approved_km double, anchor_latitude double, anchor_longitude double, anchor_m double"
    got = {r.point_id: r for r in projection.replayed(spark.createDataFrame(rows, schema), track).collect()}
    assert {i: (r.state, r.failed) for i, r in got.items()} == {
        1: ("kept", ""), 2: ("drifted", "coordinates"), 3: ("drifted", "track-distance"), 4: ("drifted", "elevation"), 5: ("drifted", "anchor-distance"), 6: ("lost", ""), 7: ("lost", ""), 8: ("lost", ""),
        9: ("drifted", "coordinates,elevation"), 10: ("kept", ""),
    }
    assert got[1].track_km == pytest.approx(half[3]) and got[2].track_km is None


def test_links_and_standalone_groups(spark):
    points = [
        (1, 1, "a", "col", "matched", 10.4, False, None), (1, 2, "b", "passage", "matched", 10.7, False, None), (1, 3, "c", "passage", "matched", 9.5, True, None), (1, 4, "d", "start", "matched", None, False, 70),
        (1, 5, "e", "col", "matched", 30.0, False, None), (1, 6, "f", "col", "matched", 30.6, False, None), (1, 7, "g", "passage", "matched", 30.65, False, None), (1, 8, "h", "col", "unmatched", 10.0, False, None),
        (1, 9, "i", "col", "matched", 10.51, False, None),
    ]
    ways = [(1, 70, 0, 10.0), (1, 71, 1, 9.0), (1, 72, 2, 20.0)]
    linked = projection.linked(
        spark.createDataFrame(points, "day_id long, point_id long, name string, kind string, status string, track_km double, overridden boolean, waypoint_id long"), spark.createDataFrame(ways, "day_id long, waypoint_id long, ordinal int, km double")
    )
    groups = {r.waypoint_id: r for r in projection.link_groups(linked).collect()}
    assert groups[70].point_ids == "4,3,1,2" and groups[70].name == "d" and groups[70].max_km == pytest.approx(0.7) and set(groups) == {70}
    assert sorted(r.point_ids for r in projection.standalone_groups(linked).collect()) == ["5", "6,7", "9"]


def test_profile_matches_equal_all_assignments(spark):
    rng = random.Random(8)
    points = [(d, d * 100 + i, i, rng.choice([None, *(rng.uniform(900, 1500) for _ in range(6))]), None) for d in range(14) for i in range(rng.randint(0, 5))]
    points = [(*p[:4], p[2] * 8.0) if rng.random() < 0.25 else p for p in points]
    summits = [(d, d * 100 + j, rng.uniform(0, 40), rng.choice([None, *(rng.uniform(900, 1500) for _ in range(9))])) for d in range(14) for j in range(rng.randint(0, 9))]
    a = spark.createDataFrame(points, "day_id long, point_id long, ordinal int, elevation_m double, fixed_km double")
    b = spark.createDataFrame(summits, "day_id long, summit_id long, km double, elevation_m double")
    got = projection.profile_matches(a, b).collect()
    assert len(got) > 5
    for d in range(14):
        own = sorted((p for p in points if p[0] == d), key=lambda p: p[2])
        fixed = [(p[2], p[4]) for p in own if p[4] is not None]
        tops = sorted((s for s in summits if s[0] == d and s[3] is not None), key=lambda s: s[2])
        tops = [s for i, s in enumerate(tops) if (i == 0 or s[2] - tops[i - 1][2] >= 2) and all(abs(s[2] - f) >= 2 for _, f in fixed)]
        free = [p for p in own if p[4] is None and p[3] is not None]

        def may(p, s, fixed=fixed):
            before, after = [f for o, f in fixed if o < p[2]], [f for o, f in fixed if o > p[2]]
            return abs(p[3] - s[3]) <= 200 and (not before or s[2] >= before[-1] + 2) and (not after or s[2] <= after[0] - 2)

        def score(pairs):
            return (len(pairs), sum(abs(p[3] - s[3]) <= 100 for p, s in pairs), -sum(abs(p[3] - s[3]) for p, s in pairs))

        best = (0, 0, 0.0)
        for n in range(1, min(len(free), len(tops)) + 1):
            for x in itertools.combinations(free, n):
                for y in itertools.combinations(tops, n):
                    pairs = list(zip(x, y, strict=True))
                    if all(may(p, s) for p, s in pairs):
                        best = max(best, score(pairs))
        by = {p[1]: p for p in points} | {("s", s[1]): s for s in summits}
        mine = [(by[r.point_id], by["s", r.summit_id]) for r in got if r.day_id == d]
        assert score(mine) == pytest.approx(best) and all(may(p, s) for p, s in mine)


def test_files_match_by_bytes_then_by_place(spark):
    schema = "trip_id long, file_id string, fingerprint string, latitude double, longitude double"
    old = spark.createDataFrame([(1, "a", "x", 45.0, 6.0), (1, "b", "x", 45.0, 6.0), (1, "c", "y", 46.0, 6.0), (1, "d", None, 46.0004, 6.0), (1, "e", "q", 50.0, 6.0)], schema)
    new = spark.createDataFrame([(1, "n1", "x", 48.0, 6.0), (1, "n2", "z", 46.0001, 6.0), (1, "n3", None, 46.0002, 6.0), (1, "n4", "w", 51.0, 6.0)], schema)
    got = {(r.old_id, r.new_id, r.state) for r in edits.by_fingerprint(old, new).collect()}
    assert got == {("a", "n1", "kept"), ("c", "n2", "moved"), ("d", "n3", "moved"), ("b", None, "dropped"), ("e", None, "dropped"), (None, "n4", "new")}


def test_loops_turn_the_shorter_way(spark):
    rng = random.Random(3)
    files = [(t, f"f{i}", i, *(rng.uniform(45, 46) for _ in range(4))) for t in range(6) for i in range(t + 1)]
    order = spark.createDataFrame(files, "trip_id long, file_name string, position int, lat1 double, lon1 double, lat2 double, lon2 double")
    first = {t: f"f{t // 2}" for t in range(5)}

    def gap(a, b):
        lat, lon = math.radians(b[3] - a[5]), math.radians(b[4] - a[6])
        h = math.sin(lat / 2) ** 2 + math.cos(math.radians(a[5])) * math.cos(math.radians(b[3])) * math.sin(lon / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    want = set()
    for t in range(6):
        own = [f for f in files if f[0] == t]
        start = next((i for i, f in enumerate(own) if f[1] == first.get(t)), None)
        if start is None:
            want |= {(t, f[1], i, "forward") for i, f in enumerate(own)}
            continue
        ways = {"forward": own[start:] + own[:start], "backward": own[start::-1] + own[:start:-1]}
        total = {k: sum(gap(a, b) for a, b in itertools.pairwise(v)) for k, v in ways.items()}
        pick = "backward" if total["backward"] < total["forward"] else "forward"
        want |= {(t, f[1], i, pick) for i, f in enumerate(ways[pick])}
    got = waypoints.rotated(order, spark.createDataFrame(list(first.items()), "trip_id long, file_name string"))
    assert {tuple(r) for r in got.collect()} == want


def test_package_hashes_do_not_depend_on_order(spark):
    files = [("p", f"f{i}", f"content {i}") for i in range(50)]
    frame = lambda rows, parts: packages.manifest(spark.createDataFrame(rows, "package_id string, path string, content string").repartition(parts))
    a, b = (packages.package_hashes(frame(rows, parts)).first().content_hash for rows, parts in ((files, 1), (files[::-1], 7)))
    assert a == b and len(a) == 60
    moved = [("p", "f1", "content 0"), ("p", "f0", "content 1"), *files[2:]]
    assert packages.package_hashes(frame(moved, 2)).first().content_hash != a
    assert {tuple(r) for r in packages.drift(frame(files, 2), frame([*moved[:-1], ("p", "g", None)], 2)).collect()} == {("p", "f0", "different"), ("p", "f1", "different"), ("p", "f49", "missing"), ("p", "g", "extra")}
    assert packages.drifted_packages(frame(files, 2), frame(files, 3)).count() == 0


def test_payloads_are_kept_replaced_removed_and_compacted(spark, tmp_path):
    known = lambda *ids: spark.createDataFrame([("t", i) for i in ids], "trip_id string, file_id string")
    given = lambda **files: spark.createDataFrame([("t", k, v.encode()) for k, v in files.items()], "trip_id string, file_id string, content binary")
    root = str(tmp_path)
    payloads.append(given(a="1", b="1").selectExpr("trip_id", "file_id", "1L as version", "'put' as op", "content"), root)
    for version, bundle, inputs in ((2, known("a", "b", "c"), given(c="2", a="2")), (3, known("a", "c"), given(c="3").limit(0))):
        payloads.append(payloads.save_rows(payloads.read_log(spark, root), bundle, inputs, version), root)
    log = payloads.read_log(spark, root)
    assert {(r.file_id, r.version, bytes(r.content)) for r in payloads.current(log).collect()} == {("a", 2, b"2"), ("c", 2, b"2")}
    assert payloads.exists(log, "t") and payloads.payload(log, "t", "a") == b"2" and payloads.payload(log, "t", "b") is None
    small = payloads.compacted(log)
    assert small.count() == 2 and payloads.current(small).count() == 2
    payloads.append(payloads.delete_rows(spark, ["t"], 4), root)
    payloads.append(given(z="5").selectExpr("trip_id", "file_id", "5L as version", "'put' as op", "content"), root)
    assert [r.file_id for r in payloads.current(payloads.read_log(spark, root)).collect()] == ["z"] and not payloads.exists(payloads.read_log(spark, root), "u")
    twice = given(a="1").union(given(a="1")).union(given(q="1"))
    assert {(r.file_id, r.code) for r in payloads.input_issues(known("a"), twice).collect()} == {("a", "duplicate-payload"), ("q", "unknown-file")}


def test_timeline_order_and_pauses(spark):
    at = lambda km: (km, km * 1.2, km * 4.0)
    edge = "struct<km:double,weighted_km:double,moving_minutes:double>"
    files = spark.createDataFrame([(1, 0, "A", "B", at(0.0), at(10.0)), (1, 1, "B", "C", at(10.0), at(20.0))], f"route_id long, file_number int, start_name string, end_name string, start {edge}, end {edge}")
    features = spark.createDataFrame([(1, 0, k, *at(km)) for k, km in (("summit", 5.0), ("summit", 1.0), ("valley", 8.5))], "route_id long, file_number int, kind string, km double, weighted_km double, moving_minutes double")
    markers = spark.createDataFrame([(1, 0, *at(km)) for km in (5.0, 7.0)], "route_id long, file_number int, km double, weighted_km double, moving_minutes double")
    pauses = spark.createDataFrame([(1, "x", "noon", 5.0, 30, 20.0), (1, "y", "none", 6.0, 0, 24.0), (1, "z", "late", 10.0, 10, 40.0)], "route_id long, pause_id string, name string, km double, minutes int, moving_minutes double")
    rows = timeline.assembled(timeline.with_markers(timeline.seeds(files, features), markers), pauses, spark.createDataFrame([(1, 480)], "route_id long, departure_minutes int"))
    got = [(r.waypoint_id, r.elapsed_minutes) for r in rows.orderBy("position").collect()]
    assert got == [
        ("route-start-0", 0.0), ("summit-0-1", 20.0), ("pause-x-start", 20.0), ("pause-x-end", 50.0), ("time-marker-1", 58.0), ("gpx-end-0", 70.0), ("gpx-start-1", 70.0), ("pause-z-start", 70.0), ("pause-z-end", 80.0),
        ("route-end-1", 120.0),
    ]
    totals = lambda *t: spark.createDataFrame([(1, *t)], "route_id long, files int, break_minutes int, moving_minutes double, total_minutes double")
    assert timeline.timeline_issues(rows, totals(2, 40, 80.0, 120.0)).count() == 0
    assert {r.code for r in timeline.timeline_issues(rows.where("kind <> 'route-end'"), totals(3, 41, 80.0, 120.0)).collect()} == {"wrong-ends", "pause-sum", "total-mismatch", "files-missing"}


def test_weather_days_and_requests(spark):
    day = dt.date(2024, 1, 1)
    days = [(1, "d0", 0, "off", day, "Inn", None, None), (1, "d1", 1, "ride", day, None, None, None), (1, "d2", 2, "transfer", day, None, "O", "D"), (1, "d3", 3, "ride", day, None, None, None), (1, "d4", 4, "off", None, "X", None, None), (1, "d5", 5, "transfer", day, None, "O", "D"),
        (2, "e0", 0, "off", day, "Inn", None, None), (2, "e1", 1, "off", day, None, None, None)]
    place = "struct<latitude:double,longitude:double,elevation_m:double>"
    ends = [(1, "d1", (1.0, 1.0, None), (2.0, 2.0, 20.0)), (1, "d3", (3.0, 3.0, 30.0), (4.0, 4.0, 40.0))]
    ways = [("d1", f"w{i:02}", "n", "saddle", 45.0 + i // 2, 6.0, None, 1.0, True) for i in range(36)] + [("d1", "x", "n", "climb", 0.0, 0.0, 1.0, None, True), ("d3", "y", "n", "climb", 0.0, 0.0, 1.0, 5.0, False)]
    rows = weather_days.definitions(
        spark.createDataFrame(days, "trip_id long, day_id string, index int, kind string, date date, name string, origin string, destination string"), spark.createDataFrame(ends, f"trip_id long, day_id string, start {place}, end {place}"),
        spark.createDataFrame(ways, "day_id string, waypoint_id string, name string, kind string, latitude double, longitude double, elevation_m double, elapsed_minutes double, significant boolean"),
    )
    got = {r.key: r for r in rows.where("key <> 'd1'").collect()}
    assert {k: (r.latitude, r.elevation_m, r.reason) for k, r in got.items()} == {
        "d0": (1.0, 0.0, None), "d2::origin": (2.0, 20.0, None), "d2::destination": (3.0, 30.0, None), "d3": (None, 0.0, "no-point"), "d5::origin": (4.0, 40.0, None), "e0": (None, None, "coordinates-unknown"),
        "e1": (None, None, "place-unknown"),
    }
    asked = weather_days.packed(rows.where("reason is null"))
    sizes = {r.request: r.n for r in asked.where("key = 'd1'").groupBy("request").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 16, 1: 2} and asked.where("size(samples) = 2").count() == 18
    answers = asked.where("request = 0").select("trip_id", "key", "request", "place", F.col("latitude").cast("string").alias("payload"))
    back = weather_days.answered(asked, answers)
    assert back.where("key = 'd1' and state = 'available' and cast(payload as double) = 45 + cast(substr(sample_id, 2) as int) div 2").count() == 32 and back.where("state = 'missing'").count() == 4


def test_a_right_document_has_no_issue_and_types_are_told(spark):
    good = documents.trip_documents(spark, "/root/testdata/sf0.001").where(f"trip_id % {documents.FAULTS} = 0").limit(3)
    assert good.count() and rules.document_issues(good, rules.BUNDLE, "trip_id", "document").count() == 0
    shape = rules.Group({"a": rules.Many(rules.Group({"n": rules.Leaf("from 0"), "t": rules.Leaf("text", "missing-required", null=True)}))}, (rules.Rule("b", "invalid-value", rules.get("{v}", "b", "int") + " > 3"),), code="invalid-root")
    texts = ['{"a":[{"n":1,"t":"x"},{"n":-1},7,{"n":"1","t":null},{"n":2,"t":" "}],"b":4}', '{"a":{}}', "[]", '{"a":[]}', "null"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, j string").withColumn("doc", F.try_parse_json("j"))
    got = sorted((r.k, r.path, r.code) for r in rules.document_issues(docs, shape, "k", "doc").collect())
    assert got == [
        (0, "a[1].n", "invalid-value"), (0, "a[1].t", "missing-required"), (0, "a[2]", "invalid-type"), (0, "a[3].n", "invalid-value"), (0, "a[4].t", "missing-required"), (0, "b", "invalid-value"), (1, "a", "invalid-type"),
        (2, "", "invalid-root"), (4, "", "invalid-root"),
    ]
