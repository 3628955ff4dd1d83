"""Names, landmarks, folds over groups."""

import itertools
import math
import random

from pyspark.sql import functions as F

from trailframe.operators import waypoints


def test_names(spark):
    df = spark.createDataFrame([("Col d’Èze  (2)",), ("--",), (None,), ("ﬁn Straße",)], "n string")
    got = [tuple(r) for r in df.select(waypoints.name_key(F.col("n")), waypoints.name_words(F.col("n"))).collect()]
    assert got == [("coldeze2", "col d eze 2"), (None, ""), (None, None), ("finstrae", "fin stra e")]


CLIMBS, MARKS = "route_id long, climb_id long, name string, end_km double", "route_id long, landmark_id long, name string, kind string, track_km double"


def test_landmarks_prefer_passes(spark):
    climbs = spark.createDataFrame([(1, 1, "x", 5.0), (1, 2, "y", 9.0), (1, 3, "z", 20.0)], CLIMBS)
    marks = spark.createDataFrame([(1, 10, "near", "saddle", 5.1), (1, 11, "pass", "mountain-pass", 6.0), (1, 12, None, "mountain-pass", 5.0), (1, 13, "s", "saddle", 8.5), (1, 14, "t", "saddle", 9.4), (2, 15, "other", "saddle", 20.0)], MARKS)
    assert sorted((r.climb_id, r.name) for r in waypoints.climb_landmarks(climbs, marks).collect()) == [(1, "pass"), (2, "t")]


def test_merging_is_one_to_one(spark):
    climbs = spark.createDataFrame([(1, 1, "Col A", 5.0), (1, 2, "col-a", 5.5), (1, 3, None, 5.0), (1, 4, "B", 5.0)], CLIMBS)
    marks = spark.createDataFrame([(1, 10, "COL A", "saddle", 5.0), (1, 11, "Col Á", "mountain-pass", 5.9)], MARKS)
    got = {r.climb_id: r.landmark_id for r in waypoints.merged_climbs(climbs, marks).collect()}
    assert got == {1: 11, 2: 10, 3: None, 4: None}


def test_duplicate_climbs(spark):
    rows = [(1, 0, 0.0, 5.0, 300.0, False, None), (1, 1, 0.5, 5.05, 310.0, False, None), (1, 2, 0.2, 5.2, 900.0, False, None), (1, 3, 0.0, 5.1, 10.0, True, None), (2, 0, 0.0, 5.0, 1.0, False, None)]
    df = spark.createDataFrame(rows, "route_id int, ordinal int, start_km double, end_km double, gain_m double, manual boolean, anchor string")
    assert sorted((r.route_id, r.ordinal) for r in waypoints.distinct_climbs(df).collect()) == [(1, 2), (1, 3), (2, 0)]


def test_groups_are_complete(spark):
    rows = [(1, i, i * 0.06, 45.0 + i * 0.0006, 6.0, 100.0) for i in range(4)] + [(1, 9, 0.01, 45.0, 6.0, 200.0)]
    df = spark.createDataFrame(rows, "day_id int, point_id long, track_km double, latitude double, longitude double, elevation_m double")
    got = {r.point_id: r.group for r in waypoints.grouped_points(df).collect()}
    assert got[0] == got[1] and got[2] == got[3] and len({got[0], got[2], got[9]}) == 3


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(d, i, rng.choice([None, 1.0, 2.0, 3.0]) if d == 3 else rng.randrange(30) / 10, 45.0 + rng.randrange(12) * 0.0004, lon + rng.randrange(4) * 0.0006, float(rng.randrange(90))) for d, lon in enumerate((6.0, 179.999, -6.0, 7.0)) for i in range(120)]
    rows += [(0, 500 + 4 * i + k, 1.0, 45.0, 6.0 + i * 0.5, up) for i in range(4) for k, up in enumerate((5.0, None, 300.0))] + [(0, 600, 1.0, None, 6.0, 5.0), (4, 1, 1.0, 45.0, 6.0, None)]
    df = spark.createDataFrame(rows, "day_id int, point_id long, track_km double, latitude double, longitude double, elevation_m double")
    want = []
    for day in range(5):
        groups: list[list[tuple]] = []
        for row in sorted((r for r in rows if r[0] == day), key=lambda r: (r[2] is None, r[2] or 0, r[1])):
            home = next((k for k, g in enumerate(groups) if all(apart(row, m) for m in g)), len(groups))
            groups[home:] = groups[home:] or [[]]
            groups[home].append(row)
            want.append((day, row[1], home))
    assert sorted(map(tuple, waypoints.grouped_points(df).collect())) == sorted(want)


def apart(a: tuple, b: tuple) -> bool:
    """Whether two points are near each other."""
    if None in (*a[3:], *b[3:]):
        return False
    (y, x), (v, u) = (map(math.radians, p[3:5]) for p in (a, b))
    half = math.sin((v - y) / 2) ** 2 + math.cos(v) * math.cos(y) * math.sin((u - x) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(half)) < 100 and abs(a[5] - b[5]) < 30


def test_every_stop_is_grouped(spark):
    from trailframe.plans.carriers import table
    from trailframe.plans.queries import grouped_stops

    got = grouped_stops(spark, "/root/testdata/sf0.001")
    assert got.count() == got.select("point_id").distinct().count() == table(spark, "/root/testdata/sf0.001", "orders").count()


def test_simplifying_keeps_the_turns(spark):
    rows = [(1, i, 45.0 + min(i, 20) * 0.001, 6.0 + max(0, i - 20) * 0.001) for i in range(41)]
    df = spark.createDataFrame(rows, "route_id int, seq int, latitude double, longitude double")
    assert sorted(r.seq for r in waypoints.simplified(df, 3).collect()) == [0, 20, 40]
    assert waypoints.simplified(df, 100).count() == 41


def test_file_order(spark):
    legs = [(1, n, num, 45.0 + a * 0.1, 6.0, 45.0 + b * 0.1, 6.0) for n, num, a, b in (("c", None, 0, 1), ("a", 2, 1, 2), ("b", 3, 2, 3))]
    legs += [(2, f"{k}.gpx", k, 45.0, 6.0, 45.0, 6.0) for k in (3, 1, 2)] + [(3, "one", None, 1.0, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(legs, "trip_id long, file_name string, number int, lat1 double, lon1 double, lat2 double, lon2 double")
    got = {}
    for r in sorted(waypoints.file_order(df).collect(), key=lambda r: (r.trip_id, r.position)):
        got.setdefault(r.trip_id, []).append((r.file_name, r.method, r.is_loop))
    assert got[1] == [("c", "place", False), ("a", "place", False), ("b", "place", False)]
    assert [n for n, *_ in got[2]] == ["1.gpx", "2.gpx", "3.gpx"] and got[2][0][1:] == ("number", True) and got[3] == [("one", "single", False)]


def test_alignment_equals_brute_force(spark):
    rng = random.Random(2)
    a = [(d, i, float(rng.randrange(0, 1000, 50))) for d in range(12) for i in range(rng.randint(0, 4))]
    b = [(d, i, float(rng.randrange(0, 1000, 50))) for d in range(12) for i in range(rng.randint(0, 5))]
    got = waypoints.aligned(spark.createDataFrame(a, "day_id long, ordinal long, elevation_m double"), spark.createDataFrame(b, "day_id long, seq long, elevation_m double")).collect()
    for d in range(12):
        x, y = [e for k, _, e in a if k == d], [e for k, _, e in b if k == d]
        best = (0, 0.0)
        for n in range(1, min(len(x), len(y)) + 1):
            for i in itertools.combinations(range(len(x)), n):
                for j in itertools.combinations(range(len(y)), n):
                    errors = [abs(x[p] - y[q]) for p, q in zip(i, j, strict=True)]
                    if max(errors) <= 150:
                        best = max(best, (n, -sum(errors)))
        mine = sorted((r.ordinal, r.seq) for r in got if r.day_id == d)
        assert (len(mine), -sum(abs(x[p] - y[q]) for p, q in mine)) == best and mine == sorted(mine, key=lambda t: t[1])


def test_slots(spark):
    df = spark.createDataFrame([("t", 1, "ride"), ("t", 2, "off"), ("t", 3, "ride")], "trip_id string, position int, kind string")
    assert [(r["index"], r.ride_number) for r in waypoints.with_slots(df).orderBy("position").collect()] == [(0, 1), (1, None), (2, 2)]


def test_name_keys_take_whole_texts(spark, tmp_path):
    from trailframe.plans.queries import name_keys

    spark.createDataFrame([(1, "Col " * 30 + "d’Èze")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in name_keys(spark, str(tmp_path)).collect()] == [(1, "col" * 30 + "deze", "col " * 30 + "d eze")]


def test_every_row_has_a_role(spark, tmp_path):
    from trailframe.plans import queries

    # no key is a multiple of 50, and the landmark's key leaves a rest of 2 by 3
    orders = [(3, 1, 110.0, "1-URGENT"), (5, 1, 110.5, "1-URGENT"), (7, 2, 50.0, "5-LOW")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1,), (2,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    assert [tuple(r) for r in queries.climb_landmarks(spark, str(tmp_path)).collect()] == [(1, 3, 5, "1-URGENT")]
    assert {r.file_name: r.planned for r in queries.planned_files(spark, str(tmp_path)).collect()} == {"f1": 2, "f2": 1}


def test_features_are_spaced_over_all_points(spark, monkeypatch):
    from trailframe.operators import climbs
    from trailframe.plans import queries

    points = spark.createDataFrame([(1, i, i * 0.1, float(i == 4)) for i in range(7)], "route_id long, seq long, distance_km double, elevation_m double")
    monkeypatch.setattr(queries, "series", lambda *_: points)
    assert sorted(r.seq for r in queries.feature_spacing(spark, "").collect()) == [0, 4]
    rng = random.Random(3)
    rows = [(1, i, i * 0.07, float(rng.randrange(40))) for i in range(150)]
    kept: list[float] = []
    for _, _, at, _ in sorted(rows, key=lambda r: (-r[3], r[2])):
        if all(abs(at - k) >= 0.4 for k in kept):
            kept.append(at)
    df = spark.createDataFrame(rows, "route_id long, seq long, distance_km double, score double")
    assert [r.distance_km for r in climbs.spaced(df, 0.4).orderBy("distance_km").collect()] == sorted(kept)
