"""Operators against closed forms, brute force and the traps of their definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailframe.functions import clock, geo
from trailframe.functions import terrain as rules
from trailframe.functions import weather
from trailframe.operators import climbs, forecast, quality, spatial, terrain, track, trip


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def hav(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_distances(spark):
    p = [F.lit(float(x)) for x in (45, 6, 45.5, 6.7)]
    assert value(spark, geo.haversine_km(*p)) == pytest.approx(hav(45, 6, 45.5, 6.7), rel=1e-12)
    assert value(spark, geo.haversine_km(*[F.lit(1.0)] * 4)) == 0
    assert value(spark, geo.equirectangular_m(*p)) / 1000 == pytest.approx(hav(45, 6, 45.5, 6.7), rel=1e-3)
    assert value(spark, geo.js_round(F.lit(-0.5))) == 0 and value(spark, geo.js_round(F.lit(2.5))) == 3
    assert value(spark, geo.valid_coordinate(F.lit(float("nan")), F.lit(1.0))) is False


@pytest.mark.parametrize(("grade", "factor", "band"), [(-20, 2.2, 1.45), (-15, 2.2, 1.45), (-6, 1.575, 1.2), (0, 1.0, 1.0), (3, 0.78, 1.0), (3.1, 0.772666, 0.78), (15, 0.32, 0.42), (99, 0.32, 0.42)])
def test_slope_rules(spark, grade, factor, band):
    assert value(spark, rules.speed_factor(F.lit(float(grade)))) == pytest.approx(factor, abs=1e-5)
    assert value(spark, rules.slope_multiplier(F.lit(float(grade)))) == band


def test_clocks(spark):
    c = clock.clock(F.lit(1430), F.lit(20.5))
    assert tuple(value(spark, c)) == (11, 1)
    assert value(spark, clock.clock_text(F.lit(11), F.lit(1))) == "00:11 (+1 j)" and value(spark, clock.clock_phrase(F.lit(11), F.lit(1))) == "00:11, le lendemain"
    assert value(spark, clock.parse_clock(F.lit("24:00"))) is None and value(spark, clock.parse_clock(F.lit("07:05"))) == 425
    assert tuple(value(spark, clock.shifted_clock(F.lit(60), F.lit(0), F.lit(-120)))) == (1380, -1, False)


def line(spark, elevations, step=0.0005):
    rows = [(1, i, 45.0 + i * step, 6.0, None if e is None else float(e)) for i, e in enumerate(elevations)]
    return spark.createDataFrame(rows, "route_id int, seq int, latitude double, longitude double, elevation_m double")


def test_elevation_compares_with_the_last_known(spark):
    m = track.metrics(line(spark, [None, 100, None, 110, 105, None]), "route_id").first()
    assert (m.gain_m, m.loss_m, m.with_altitude, m.sufficient) == (10, 5, 3, True)
    alone = track.metrics(line(spark, [None, 100, None]), "route_id").first()
    assert alone.gain_m is None and alone.loss_m is None and not alone.sufficient


def test_smoothing_reaches_points_without_altitude(spark):
    s = terrain.smooth(track.cumulative(line(spark, [100, None, 110]), "route_id")).orderBy("seq").collect()
    assert [r.smoothed_m for r in s] == [100, 105, 110]


def test_grid_ends_at_the_end(spark):
    s = track.cumulative(line(spark, range(10)), "route_id")
    g = [r.target_km for r in terrain.grid(s, 0.05).orderBy("k").collect()]
    total = hav(45, 6, 45.0045, 6)
    assert g[0] == 0 and g[-1] == pytest.approx(total) and len(g) == math.ceil(total / 0.05) + 1


def test_flat_timing_is_distance_over_speed(spark):
    s = terrain.smooth(track.cumulative(line(spark, [100] * 200), "route_id"))
    t = terrain.timing(terrain.slope_profile(s), 18.0).orderBy("k").collect()
    assert t[-1].moving_minutes == pytest.approx(hav(45, 6, 45.0995, 6) / 18 * 60)
    assert all(x.moving_minutes <= y.moving_minutes for x, y in zip(t, t[1:], strict=False))


def test_pause_counts_after_its_place(spark):
    timed = spark.createDataFrame([(1, k, float(k)) for k in range(4)], "route_id int, k int, distance_km double")
    stop = spark.createDataFrame([(1, 2.0, 30.0)], "route_id int, pause_km double, minutes double")
    assert [r.paused_minutes for r in terrain.with_pauses(timed, stop).orderBy("k").collect()] == [0, 0, 0, 30]


def profile(spark, elevations):
    rows = [(1, i, i * 0.05, float(e), 5.0) for i, e in enumerate(elevations)]
    return spark.createDataFrame(rows, "route_id int, k int, distance_km double, elevation_m double, grade double")


def test_one_ramp_is_one_climb(spark):
    up = list(range(0, 205, 5))
    got = climbs.detect(profile(spark, up + up[::-1])).collect()
    assert len(got) == 1 and got[0].gain_m == 200 and got[0].start_km == 0 and got[0].end_km == pytest.approx(2.0)
    assert got[0].average_grade == pytest.approx(10)


def test_small_dip_doesnt_end_a_climb_and_a_deep_one_does(spark):
    a = list(range(0, 105, 5))
    small = a + list(range(95, 75, -5)) + list(range(80, 205, 5))
    deep = a + list(range(95, 40, -5)) + list(range(45, 205, 5))
    one, two = (climbs.detect(profile(spark, x)).collect() for x in (small, deep))
    assert len(one) == 1 and one[0].gain_m == 220 and one[0].average_grade < one[0].gain_m / ((one[0].end_km - one[0].start_km) * 10)
    assert len(two) == 2 and [r.number for r in two] == [1, 2]
    assert climbs.detect(profile(spark, [5, 5, 5])).count() == 0


def test_turns_equal_a_plain_zigzag():
    rng = random.Random(1)
    for _ in range(50):
        e = np.cumsum([rng.choice([-3, -0.4, 0, 0.4, 3]) for _ in range(60)])
        at = climbs.turns(e)
        assert at == sorted(at) and at[0] == 0 and at[-1] == 59
        signs = np.sign(np.diff(e[at]))[: -1 if abs(e[at[-1]] - e[at[-2]]) < 1 else None]
        assert all(a != b for a, b in zip(signs, signs[1:], strict=False) if a and b)


def test_largest_remainder_sums_up(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.randint(0, 500), rng.random()) for g in range(20) for i in range(rng.randint(1, 6))]
    totals = {g: t for g, _, t, _ in rows}
    df = spark.createDataFrame([(g, i, totals[g], s) for g, i, _, s in rows], "g int, i int, total int, share double")
    got = trip.allocate(df, "g", ("i",), "total", "share").groupBy("g").agg(F.sum("allocated").alias("n")).collect()
    assert {r.g: r.n for r in got} == totals


HOURS = "location_id int, time timestamp_ntz, apparent_c double, precipitation_mm double, precipitation_pct double, snowfall_cm double, weather_code int, wind_kph double, gust_kph double, visibility_m double, freezing_m double"


def hours(spark, rows):
    base = {"apparent_c": 15.0, "precipitation_mm": 0.0, "precipitation_pct": 0.0, "snowfall_cm": 0.0, "weather_code": 0, "wind_kph": 0.0, "gust_kph": 0.0, "visibility_m": 9e4, "freezing_m": 9e4}
    names = [x.split()[0] for x in HOURS.split(", ")]
    data = [tuple(({"location_id": 1, "time": t} | base | more)[n] for n in names) for t, more in rows]
    df = spark.createDataFrame(data, HOURS.replace("time timestamp_ntz", "time string"))
    return df.withColumn("time", F.col("time").cast("timestamp_ntz"))


def points(spark, rows):
    df = spark.createDataFrame(rows, "point_id int, location_id int, day_id int, eta string, elevation_m double, kind string, strategic boolean")
    return df.withColumn("eta", F.col("eta").cast("timestamp_ntz"))


def test_nearest_hour_ties_and_tolerance(spark):
    h = hours(spark, [("2024-01-01 10:00:00", {"apparent_c": 1.0}), ("2024-01-01 11:00:00", {"apparent_c": 2.0}), ("2024-01-01 23:00:00", {})])
    p = points(spark, [(1, 1, 1, "2024-01-01 10:30:00", 0.0, "poi", False), (2, 1, 1, "2024-01-01 12:00:00", 0.0, "poi", False), (3, 1, 1, "2024-01-01 12:01:00", 0.0, "poi", False), (4, 2, 1, "2024-01-01 10:00:00", 0.0, "poi", False), (5, 1, 1, "2024-01-02 00:00:00", 0.0, "poi", False)])
    got = {r.point_id: r.apparent_c for r in forecast.nearest_hour(p, h).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: None, 4: None, 5: 15.0}


def test_hazards_in_their_order(spark):
    h = hours(spark, [("2024-01-01 10:00:00", {"apparent_c": 4.0, "gust_kph": 46.0, "snowfall_cm": 0.5, "visibility_m": 5000.0, "precipitation_mm": 0.6, "precipitation_pct": 60.0, "weather_code": 95, "freezing_m": 1700.0})])
    p = points(spark, [(1, 1, 1, "2024-01-01 10:00:00", 1500.0, "poi", False), (2, 1, 1, "2024-01-01 10:01:00", 1499.0, "poi", False)])
    near = forecast.nearest_hour(p, h).withColumn("upcoming", F.lit(True))
    got = {}
    for r in forecast.alerts(near).orderBy("ord").collect():
        got.setdefault(r.point_id, []).append((r.risk, r.level))
    assert got[1] == [("precipitation", "orange"), ("thunderstorm", "orange"), ("snow", "red"), ("cold", "orange"), ("gust", "orange"), ("freezing-level", "red")]
    assert got[2] == [("precipitation", "orange"), ("thunderstorm", "orange"), ("snow", "orange"), ("freezing-level", "orange")]


def test_interleaved_alerts_dont_merge(spark):
    rows = [(1, 10, "cold", "red", 1), (1, 10, "wind", "red", 2), (1, 11, "cold", "red", 3), (1, 11, "wind", "red", 4), (1, 12, "wind", "red", 5), (1, 13, "wind", "orange", 6)]
    df = spark.createDataFrame([(d, p, r, l, o, "2024-01-01", 1.0 * o, o == 5) for d, p, r, l, o in rows], "day_id int, point_id int, risk string, level string, ord int, eta string, value double, upcoming boolean")
    got = [(r.risk, r.level, r.alerts, r.value, r.upcoming) for r in forecast.alert_groups(df).orderBy("island").collect()]
    assert got == [("cold", "red", 1, 1, False), ("wind", "red", 1, 2, False), ("cold", "red", 1, 3, False), ("wind", "red", 2, 5, True), ("wind", "orange", 1, 6, False)]


def test_ranking_of_missing_values(spark):
    base = {"day_id": 1, "red": 0, "orange": 0, "covered": 5, "rain_mm": 1.0, "gust_kph": 1.0, "apparent_c": 1.0, "exposed_c": 1.0, "visibility_m": 1.0, "coherent": True}
    rows = [base | {"offset": 0}, base | {"offset": 60, "rain_mm": None}, base | {"offset": -60, "apparent_c": None}, base | {"offset": 120, "coherent": False, "rain_mm": 0.0}]
    schema = "day_id int, offset int, red int, orange int, covered int, rain_mm double, gust_kph double, apparent_c double, exposed_c double, visibility_m double, coherent boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    ranked = forecast.ranked(df)
    assert [r.offset for r in ranked.orderBy("rank").collect()] == [-60, 0, 60, 120]
    context = spark.createDataFrame([(1, "live", False, None)], "day_id int, mode string, departed boolean, age_hours double")
    assert forecast.recommendation(ranked.withColumn("coverage", F.lit(1.0)), context).first().status == "keep-current"


def test_worst_code(spark):
    df = spark.createDataFrame([(1, 95), (1, 7), (1, None), (2, 7), (3, None), (4, 73), (4, 81)], "g int, c int")
    got = {r.g: r.w for r in df.groupBy("g").agg(weather.worst_code(F.col("c")).alias("w")).collect()}
    assert got == {1: 95, 2: 7, 3: None, 4: 81}


def test_nearest_segment_equals_brute_force(spark):
    rng = random.Random(5)
    pts = [(r, i, 45 + 0.001 * i + rng.random() * 1e-4, 6 + 0.002 * r + rng.random() * 1e-3) for r in range(3) for i in range(30)]
    tracks = spark.createDataFrame([(*p, None) for p in pts], "route_id int, seq int, latitude double, longitude double, elevation_m double")
    where = [(i, 45 + rng.random() * 0.03, 6 + rng.random() * 0.006) for i in range(40)]
    got = {(r.place_id, r.route_id): (r.segment, r.lateral_m) for r in spatial.nearest_segment(spark.createDataFrame(where, "place_id int, latitude double, longitude double"), tracks, 120.0).collect()}
    want = {}
    scale = 6_371_000 * math.pi / 180
    for i, lat, lon in where:
        for a, b in zip(pts, pts[1:], strict=False):
            if a[0] == b[0]:
                x = math.cos(math.radians((a[2] + b[2] + lat) / 3)) * scale
                e, p = ((b[3] - a[3]) * x, (b[2] - a[2]) * scale), ((lon - a[3]) * x, (lat - a[2]) * scale)
                t = max(0.0, min(1.0, (p[0] * e[0] + p[1] * e[1]) / (e[0] ** 2 + e[1] ** 2)))
                d = math.hypot(p[0] - t * e[0], p[1] - t * e[1])
                if d <= 120 and d < want.get((i, a[0]), (0, 1e9))[1]:
                    want[i, a[0]] = (a[1], d)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_thinning_is_greedy_by_distance(spark):
    rows = [(1, 9, 5.0, 45.0, 6.0, "a"), (2, 9, 6.0, 45.0002, 6.0, "a"), (3, 9, 7.0, 45.0004, 6.0, "a"), (4, 9, 1.0, 45.0, 6.0, "b")]
    df = spark.createDataFrame(rows, "place_id int, route_id int, lateral_m double, latitude double, longitude double, name string")
    assert sorted(r.place_id for r in spatial.greedy_thinned(df, "name", 40.0).collect()) == [1, 3, 4]


def test_similar_tracks_find_planted_pairs(spark):
    def one(i, lat):
        return (i, 2.0, [(lat + k * 0.005, 6.0) for k in range(5)])

    df = spark.createDataFrame([one(1, 45.0), one(2, 45.001), one(3, 46.0), (4, 3.0, one(0, 45.0)[2])], "route_id int, distance_km double, samples array<struct<latitude: double, longitude: double>>")
    assert [(r.a, r.b, r.match) for r in spatial.similar_tracks(df).collect()] == [(1, 2, 1.0)]


def test_places_come_from_the_nearest_ride_even_without_name(spark):
    rows = [("t", 1, "ride", "A", None, None), ("t", 2, "off", None, None, None), ("t", 3, "ride", "B", "C", None), ("t", 4, "off", None, None, "hand"), ("u", 1, "off", None, None, None), ("u", 2, "ride", "D", "E", None), ("v", 1, "off", None, None, None)]
    df = spark.createDataFrame(rows, "trip_id string, position int, kind string, departure string, arrival string, manual string")
    got = {(r.trip_id, r.position): (r.place, r.source) for r in trip.fill_places(df).collect()}
    assert got == {("t", 2): (None, "previous"), ("t", 4): ("hand", "manual"), ("u", 1): ("D", "next"), ("v", 1): (None, "none")}


def test_three_conventions_of_missing_sums(spark):
    df = spark.createDataFrame([("t", "ride", 10.0), ("t", "ride", None), ("u", "ride", None), ("w", "ride", 4.0)], "trip_id string, kind string, distance_km double").withColumns({"attached": F.lit(False), "gain_m": F.lit(None).cast("double")})
    got = {r.trip_id: (r.known_km, r.zero_km, r.complete_km) for r in trip.trip_totals(df).collect()}
    assert got == {"t": (10, 10, None), "u": (None, 0, None), "w": (4, 4, 4)}


def test_versions(spark):
    df = spark.createDataFrame([(5,), (6,), (4,), (2,), (1,), (0,), (None,)], "schema_version int")
    got = {r.schema_version: r.status for r in quality.versions(df, 5, (2, 3, 4)).collect()}
    assert got == {5: "current", 6: "future", 4: "migrate", 2: "migrate", 1: "no-migration", 0: "invalid", None: "invalid"}


def test_results_dont_depend_on_partitions(spark):
    rng = random.Random(9)
    pts = line(spark, [rng.random() * 50 for _ in range(120)])
    a, b = (track.cumulative(p, "route_id").orderBy("seq").collect() for p in (pts, pts.repartition(7)))
    assert a == b


def test_entry_lists_every_query_with_a_function():
    import __spark_entry__

    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and len(names) >= 60
