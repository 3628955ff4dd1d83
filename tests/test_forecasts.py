"""Answers of the forecast service, aligned, checked and normalised; heights and grades of climb tiles."""

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from trailframe.operators import climbs
from trailframe.sources import forecasts

TIMES = ["2024-01-01T00:00", "2024-01-01T01:00"]


def place(**more):
    units = {"temperature_2m": "°C", "precipitation": "mm"}
    return {"latitude": 45, "longitude": 6, "timezone": "Europe/Paris", "hourly_units": units, "hourly": {"time": TIMES, "temperature_2m": [1, "x"], "precipitation": [0.5, None]}, **more}


@pytest.fixture(scope="module")
def answers(spark):
    daily = {"daily_units": {"sunrise": "iso8601", "precipitation_sum": "mm"}, "daily": {"time": ["2024-01-01"], "sunrise": ["2024-01-01T08:00"], "precipitation_sum": [2]}}
    payloads = {
        1: [place(location_id=2, **daily), place(location_id=0), {"error": True, "reason": "no"}, place(location_id=0)], 2: place(timezone="UTC"), 3: "nonsense",
        4: [place(hourly={"time": TIMES[::-1]}), place(latitude=None), place(hourly={"time": TIMES, "temperature_2m": [1]}), place(location_id=9)], 5: [],
    }
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in payloads.items()], "request int, j string").select("request", F.try_parse_json("j").alias("payload"))
    asked = [(1, p) for p in range(4)] + [(2, 0), (3, 0)] + [(4, p) for p in range(4)] + [(5, 0), (5, 1), (6, 0)]
    return forecasts.read(rows, spark.createDataFrame([(r, p, "Europe/Paris", ["2024-01-01"] if r != 2 else ["2024-01-02"]) for r, p in asked], "request int, place int, timezone string, dates array<string>"))


def test_places_are_aligned_and_told_apart(answers):
    got = {(r.request, r.place): r.reason for r in answers.collect()}
    assert got == {
        (1, 0): None, (1, 1): "no-answer", (1, 2): None, (1, 3): "no-answer", (2, 0): None, (3, 0): "no-answer", (4, 0): "bad-hours", (4, 1): "incomplete", (4, 2): None, (4, 3): None, (5, 0): "no-answer", (5, 1): "no-answer",
        (6, 0): "no-answer",
    }


def test_columns_without_their_unit_or_length_are_null(answers):
    hours = [(r.request, r.place, r.time.hour, r.temperature_2m, r.precipitation) for r in forecasts.hours(answers).orderBy("request", "place", "time").collect()]
    assert hours == [(r, p, h, 1.0 if h == 0 and (r, p) != (4, 2) else None, 0.5 if h == 0 and (r, p) != (4, 2) else None) for r, p in ((1, 0), (1, 2), (2, 0), (4, 2), (4, 3)) for h in (0, 1)]
    assert {(r.request) for r in forecasts.hours(answers, "dates").collect()} == {1, 4}
    issues = {(r.request, r.place): {(i.code, i.variable) for i in r.issues} for r in answers.where("issues is not null").collect()}
    assert ("value", "hourly.temperature_2m") in issues[1, 0] and ("unit", "hourly.rain") in issues[1, 0] and ("bad-days", None) in issues[1, 0] and ("other-timezone", None) in issues[2, 0]
    assert ("column", "hourly.temperature_2m") in issues[4, 2] and ("unit", "hourly.temperature_2m") not in issues[4, 2] and ("bad-days", None) not in issues[1, 2] and ("unit", "daily.sunset") in issues[1, 2]
    assert [(r.request, r.place, r.date, r.sunrise, r.precipitation_sum) for r in forecasts.days(answers).collect()] == [(1, 2, "2024-01-01", "2024-01-01T08:00", 2.0)]


def test_status_of_whole_answers(answers):
    got = {r.request: (r.status, r.answered, r.dates) for r in forecasts.statuses(answers).collect()}
    assert got[1] == ("partial", 2, ["2024-01-01"]) and got[3] == ("error", 0, []) and got[2][0] == "partial" and got[5][0] == "error"


def test_tiles_have_heights_and_grades(spark):
    series = spark.createDataFrame([(1, 0.0, 100.0), (1, 1.0, 200.0), (1, 1.2, None), (1, 2.0, 180.0)], "route_id long, distance_km double, elevation_m double")
    found = spark.createDataFrame([(1, 1, 0.25, 1.75)], "route_id long, number int, start_km double, end_km double")
    got = [(r.tile, r.from_m, r.to_m, round(r.grade, 6), r.grade_class) for r in climbs.tile_profile(found, series).orderBy("tile").collect()]
    assert got == [(0, 125.0, 175.0, 10.0, "climb-8-12"), (1, 175.0, 180.0, 1.0, "climb-1-4"), (2, 180.0, 180.0, 0.0, "climb-0-1")]
    assert climbs.tile_profile(found, series.where("elevation_m is null")).where("grade is not null").count() == 0


def test_reading_an_answer_goes_with_its_hours_not_with_their_square(spark):
    """Neither times nor values are read once more for each hour: 8,000 hours took minutes, and take seconds."""
    n = 8_000
    times = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i)).strftime("%Y-%m-%dT%H:%M") for i in range(n)]
    answer = place(hourly={"time": times, "temperature_2m": list(range(n)), "precipitation": [None if i % 4 == 0 else i for i in range(n)]})
    rows = spark.createDataFrame([(1, json.dumps(answer))], "request int, j string").select("request", F.try_parse_json("j").alias("payload"))
    read = forecasts.read(rows, spark.createDataFrame([(1, 0, "Europe/Paris")], "request int, place int, timezone string"))
    began = time.time()
    got = forecasts.hours(read).agg(F.count("*"), F.sum("temperature_2m"), F.count("precipitation"), F.count("rain")).first()
    assert tuple(got) == (n, n * (n - 1) / 2, n * 3 // 4, 0)
    assert "other-timezone" not in [i.code for i in read.first().issues]
    assert time.time() - began < 30
