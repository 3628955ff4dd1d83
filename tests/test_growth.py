"""What many rows at one place cost: joins are of places, so their rows don't go with the square of the copies."""

import datetime

from pyspark.sql import functions as F

from trailframe.operators import projection, rules, spatial, waypoints
from trailframe.plans import documents, journeys, planning, queries


def joined(df) -> tuple[list, int]:
    """The rows, and how many rows the largest join made for them."""
    rows, seen = df.collect(), [0]

    def walk(plan) -> None:
        kind = plan.getClass().getSimpleName()
        inner = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan() if kind.endswith("QueryStageExec") else None
        if "Join" in kind:
            seen.append(plan.metrics().apply("numOutputRows").value())
        under = plan.children()
        for child in [inner] if inner is not None else [under.apply(i) for i in range(under.size())]:
            walk(child)

    walk(df._jdf.queryExecution().executedPlan())
    return rows, max(seen)


def test_nearest_named_meets_places_not_copies(spark):
    points = spark.range(600).selectExpr("1L as route_id", "id as point_id", "if(id < 3, null, concat('n', id)) as name", "45D + id % 2 * 0.0001 as latitude", "6D as longitude")
    tops = spark.range(600).selectExpr("1L as route_id", "id as top_id", "45D + id % 2 * 0.0001 as latitude", "6D as longitude")
    rows, most = joined(spatial.nearest_named(tops, points, 0.08))
    assert sorted((r.top_id, r.point_id, r.name, r.far_km) for r in rows) == [(i, 4 - i % 2, f"n{4 - i % 2}", 0.0) for i in range(600)]
    assert most <= 600


def test_clock_shifts_round_the_double_itself(spark, tmp_path):
    """849.50 / 100 is a little under 8.495, 1049.50 / 100 isn't: the first stays under half a minute."""
    spark.createDataFrame([(0, 849.5), (1, 1049.5)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.clock_minutes for r in queries.clock_shifts(spark, str(tmp_path)).collect()}
    assert got == {0: 8, 1: 12}


def test_projected_points_go_on_where_the_sample_leaves_the_globe(spark, tmp_path):
    """Routes from 4,501 on lie beyond the 90th degree; the query keeps them, as its SQL does."""
    at = datetime.datetime(2024, 1, 1)
    events = [(i, at + datetime.timedelta(minutes=i), route, "click", 1.0) for route in (1, 4600) for i in range(3)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(10,), (46_000,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    assert sorted((r.route_id, r.point_id) for r in planning.projected_points(spark, str(tmp_path)).collect()) == [(1, 10), (4600, 46_000)]
    place = spark.createDataFrame([(1, 1, None, 6.0)], "route_id long, point_id long, latitude double, longitude double")
    assert projection.projected(place, planning.track_vertices(spark, str(tmp_path)), on_globe=False).count() == 0


def test_climb_landmarks_make_no_pairs(spark):
    """Against all pairs, with ties of distance, both ranks, nameless marks and tops without any."""
    climbs = spark.range(300).selectExpr("id % 3 as route_id", "id as climb_id", "if(id = 7, null, (id * 37 % 90) / 10D) as end_km")
    marks = spark.range(400).selectExpr("id % 3 as route_id", "(id * 7) % 400 as landmark_id", "if(id % 5 = 0, null, concat('n', id)) as name", "if(id % 4 = 1, 'mountain-pass', if(id % 9 = 2, null, 'saddle')) as kind", "if(id = 8, null, (id * 53 % 170) / 20D) as track_km")
    marks = marks.where("kind is null or kind <> 'mountain-pass' or track_km < 3")
    rows, most = joined(waypoints.climb_landmarks(climbs, marks, 0.3))
    far = lambda c, m: abs(m.track_km - c.end_km)
    want = []
    for c in climbs.where("end_km is not null").collect():
        near = [m for m in marks.where("name is not null and track_km is not null").collect() if m.route_id == c.route_id and far(c, m) <= 0.3]
        if near:
            best = min(near, key=lambda m: (m.kind != "mountain-pass", far(c, m), m.landmark_id))
            want.append((c.route_id, c.climb_id, best.landmark_id, best.name))
    assert sorted(map(tuple, rows)) == sorted(want) and 100 < len(want) < 299
    assert most <= 300


def test_summit_names_meet_places_not_copies(spark):
    rows = spark.range(600).selectExpr("id", "45D + id % 2 * 0.0001 as latitude", "6D as longitude", "if(id % 3 = 0, null, 500D) as elevation_m")
    candidates = rows.withColumnRenamed("id", "candidate_id").withColumn("name", F.concat(F.lit("n"), "candidate_id")).withColumn("kind", F.lit("saddle"))
    got, most = joined(waypoints.summit_names(rows.withColumnRenamed("id", "climb_id"), candidates))
    assert sorted((r.climb_id, r.candidate_id, r.name) for r in got) == [(i, i % 2, f"n{i % 2}") for i in range(600)]
    assert most <= 600


def test_places_at_one_spot_meet_a_track_once(spark):
    track = spark.range(50).selectExpr("1L as route_id", "id as seq", "45D + id * 0.0003 as latitude", "6D as longitude")
    places = spark.range(600).selectExpr("id as place_id", "45D + id % 2 * 0.0001 as latitude", "6.0001D as longitude")
    for got, most in (joined(spatial.routes_in_reach(places, track, 1500.0)), joined(spatial.nearest_segment(places, track, 1500.0))):
        assert sorted(r.place_id for r in got) == list(range(600))
        assert most <= 600


def test_days_share_the_frames_of_a_batch(spark):
    """A frame a day costs more than its fold: neither operator makes one."""
    rows = spark.range(60).selectExpr("id % 20 as day_id", "id as point_id", "id as ordinal", "100D + id as elevation_m", "cast(null as double) as fixed_km", "id * 1D as track_km", "45D as latitude", "6D + id * 0.000001 as longitude")
    summits = spark.range(20).selectExpr("id as day_id", "id + 1000 as summit_id", "5D as km", "110D + id as elevation_m")
    matches, groups = projection.profile_matches(rows, summits), waypoints.grouped_points(rows, 1000.0, 100.0)
    for df in (matches, groups):
        assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
    # the passes of a day differ by 10, 10 and 30 m from its summit; of equals the later one is matched
    assert sorted((r.day_id, r.point_id, r.summit_id, r.height_m) for r in matches.collect()) == [(d, d + 20, d + 1000, 10.0) for d in range(20)]
    assert sorted((r.day_id, r.point_id, r.group) for r in groups.collect()) == sorted((i % 20, i, 0) for i in range(60))


def test_timelines_and_profiles_are_worked_out_once(spark):
    """Tables read by the plans, each with all that is made of it: 24 and 16 before."""
    scans = lambda query: query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(journeys.timeline_issues) <= 13
    assert scans(queries.positions_at) <= 12


def test_documents_are_read_once_not_value_by_value(spark):
    """A cast of a variant for each value cost most of the checks; texts and variants are told the same, odd ones too."""
    shape = rules.Group(
        {"a": rules.Many(rules.Group({"n": rules.Leaf("from 0"), "t": rules.Leaf("text", null=True), "g": rules.Group({"x": rules.Leaf("boolean")}, null=True)})), "l": rules.Many(rules.Leaf(rules.TEXT, null=True), null=True)},
        code="invalid-root",
    )
    texts = [
        '{"a":[{"n":1,"t":"q\\"a:5, b\\\\","g":null},{"n":0.5,"t":null,"g":{"x":true}}],"l":null}', '{ "a" : [ {"n" : 1e999, "t" : "null", "g" : {"x" : "true"}} ] , "l" : ["7", null, 7, "a:null}"] }',
        '{"a":[{"n":"1","t":7,"g":1},7,null,{"n":-1,"g":null}],"l":{}}', '{"a":null,"l":[]}', '{"a":[],"a":[]}', "{'a':[]}", "7", "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, j string").withColumn("v", F.try_parse_json("j"))
    want = {(1, "a[0].g.x"), (1, "l[2]"), (2, "a[0].n"), (2, "a[0].t"), (2, "a[0].g"), (2, "a[1]"), (2, "a[2]"), (2, "a[3].n"), (2, "a[3].t"), (2, "l"), (3, "a"), (4, ""), (5, ""), (6, ""), (7, "")}
    for column in ("j", "v"):
        found = rules.document_issues(docs, shape, "k", column)
        # a variant has no number for what is infinite: to_json makes it a text
        assert {(r.k, r.path) for r in found.collect()} == want | ({(1, "a[0].n")} if column == "v" else set())
    plan = documents.bundle_issues(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "schema_of_variant" not in plan and "map<string,variant>" not in plan.lower() and "Window" not in plan


def test_an_entity_without_id_hides_no_unknown_reference(spark):
    text = '{"routes":[{"sourceFileId":"f2"}],"sourceFiles":[{"id":"f1"},{}]}'
    found = rules.document_issues(spark.createDataFrame([(1, text)], "k int, j string").select("k", F.try_parse_json("j").alias("v")), rules.BUNDLE, "k", "v")
    assert found.where("path = 'routes[0].sourceFileId' and code = 'unknown-reference'").count() == 1
