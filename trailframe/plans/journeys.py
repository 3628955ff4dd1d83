"""Queries of keyed state, timelines, loops, packages, payloads and weather days over the driver's tables, with their SQL (DuckDB)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailframe.operators import climbs, packages, timeline, track, waypoints, weather_days
from trailframe.plans.carriers import STEPS_SQL, hav, table, track_points
from trailframe.plans.queries import rounded
from trailframe.sources import forecasts, payloads
from trailframe.streaming import states


def job_transitions(spark, sf_dir):
    """Eight events of a user are the log of a job, with failures and repeated starts."""
    e, n = table(spark, sf_dir, "events"), F.col("n")
    rows = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    step = F.element_at(F.array(*[F.lit(s) for s in states.STEPS]), (n % 8 % 5 + 1).cast("int"))
    status = F.when(F.col("event_id") % 7 == 0, "failed").when(F.col("event_id") % 11 == 0, "pending").otherwise(step)
    log = rows.select(
        (F.col("user_id") * 1000 + F.floor(n / 8)).alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), status.alias("status"),
        F.when(F.col("event_id") % 4 != 0, F.floor("value") / 1000).alias("progress"), F.when(status == "failed", F.concat(F.lit("e"), (F.col("event_id") % 9).cast("string"))).alias("error"),
    )
    return rounded(states.transitions(log).drop("at"), 6)


def forecast_answers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    payload = F.when(F.col("event_type").isin("purchase", "signup"), F.concat(F.lit("p"), F.col("event_id").cast("string")))
    log = e.select(F.col("user_id").alias("request"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), payload.alias("payload"))
    return rounded(states.answered(log, fresh_minutes=600).drop("at"), 4)


def route_files(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Points of routes with rounded distances, and the files of each: forty points and the next file's first."""
    km = F.round("distance_km", 6)
    points = track.cumulative(track_points(spark, sf_dir), "route_id").select("route_id", F.col("segment_index").alias("file_number"), "seq", km.alias("km"), (km * 1.2).alias("weighted_km"), (km * 4).alias("moving_minutes"))
    at = F.struct("km", "weighted_km", "moving_minutes")
    files = points.groupBy("route_id", "file_number").agg(F.min_by(at, "seq").alias("start"), F.max_by(at, "seq").alias("_last"))
    files = files.withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy("route_id").orderBy("file_number")), "_last")).drop("_last")
    return points, files.withColumn("start_name", F.concat(F.lit("from "), "file_number")).withColumn("end_name", F.concat(F.lit("to "), "file_number"))


def timelines(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    points, files = route_files(spark, sf_dir)
    s = F.col("seq")
    kind = F.when(s % 17 == 8, "summit").when(s % 23 == 5, "valley").when(s % 29 == 11, "slope-change")
    seeds = timeline.seeds(files, points.withColumn("kind", kind).where("kind is not null"), 0.3)
    marked = timeline.with_markers(seeds, points.where("seq % 13 = 6"), 0.02)
    stops = points.where("seq % 50 = 20").select("route_id", s.alias("pause_id"), F.lit("stop").alias("name"), "km", F.when(F.col("route_id") % 7 == 0, 0).otherwise(5 + s % 3 * 5).alias("minutes"), "moving_minutes")
    departures = track_points(spark, sf_dir).select("route_id").distinct().withColumn("departure_minutes", F.lit(480) + F.col("route_id") % 60)
    totals = files.groupBy("route_id").agg(F.count("*").alias("files"), F.max("end.moving_minutes").alias("moving_minutes")).join(stops.groupBy("route_id").agg(F.sum("minutes").alias("break_minutes")), "route_id", "left")
    totals = totals.fillna(0, ["break_minutes"]).withColumn("total_minutes", F.col("moving_minutes") + F.col("break_minutes"))
    return timeline.assembled(marked, stops, departures), totals


def timeline_assembly(spark, sf_dir):
    return rounded(timelines(spark, sf_dir)[0].select("route_id", "waypoint_id", "kind", "position", "km", "elapsed_minutes", "clock_minutes"), 6)


def timeline_issues(spark, sf_dir):
    """Planted faults, by the route's number."""
    rows, totals = timelines(spark, sf_dir)
    d, kind = F.col("route_id") % 10, F.col("kind")
    rows = rows.withColumn("waypoint_id", F.when((d == 1) & (kind == "gpx-start"), "route-start-0").otherwise(F.col("waypoint_id"))).where(~((d == 4) & (kind == "route-end")))
    rows = rows.withColumn("clock_minutes", F.when((d == 6) & (kind == "route-start"), None).otherwise(F.col("clock_minutes")))
    rows = rows.withColumn("km", F.col("km") + F.when((d == 7) & (kind == "route-end"), -1.0).when((d == 8) & (kind == "gpx-start"), 0.001).otherwise(0.0))
    totals = totals.withColumn("break_minutes", F.col("break_minutes") + F.when(d == 2, 1).otherwise(0)).withColumn("files", F.col("files") + F.when(d == 5, 1).otherwise(0))
    totals = totals.withColumn("total_minutes", F.col("moving_minutes") + F.col("break_minutes") + F.when(d == 3, 1).otherwise(0))
    return timeline.timeline_issues(rows, totals)


TIMELINE_SQL = f"""{STEPS_SQL}, p AS (
    SELECT route_id, segment_index AS f, seq, round(distance_km, 6) AS km, round(distance_km, 6) * 1.2::DOUBLE AS w, round(distance_km, 6) * 4 AS m FROM series
), fl AS (
    SELECT route_id, f, a, coalesce(lead(a) OVER (PARTITION BY route_id ORDER BY f), b) AS b, row_number() OVER (PARTITION BY route_id ORDER BY f) = 1 AS first, lead(f) OVER (PARTITION BY route_id ORDER BY f) IS NULL AS last
    FROM (SELECT route_id, f, min(km) AS a, max(km) AS b FROM p GROUP BY ALL)
), ft AS (
    SELECT p.*, CASE WHEN seq % 17 = 8 THEN 'summit' WHEN seq % 23 = 5 THEN 'valley' WHEN seq % 29 = 11 THEN 'slope-change' END AS kind FROM p
), sd AS (
    SELECT route_id, CASE WHEN first THEN 'route-start' ELSE 'gpx-start' END AS kind, CASE WHEN first THEN 'route-start-' ELSE 'gpx-start-' END || f AS id, a AS km, f FROM fl
    UNION ALL SELECT route_id, CASE WHEN last THEN 'route-end' ELSE 'gpx-end' END, CASE WHEN last THEN 'route-end-' ELSE 'gpx-end-' END || f, b, f FROM fl
    UNION ALL SELECT route_id, kind, kind || '-' || f || '-' || row_number() OVER (PARTITION BY route_id ORDER BY f, km, kind), km, f
        FROM (SELECT ft.route_id, ft.kind, ft.f, ft.km FROM ft JOIN fl ON fl.route_id = ft.route_id AND fl.f = ft.f WHERE kind IS NOT NULL AND km - a >= 0.3 AND b - km >= 0.3)
), mk AS (
    SELECT route_id, 'time-marker' AS kind, 'time-marker-' || row_number() OVER (PARTITION BY route_id ORDER BY w) AS id, km, f FROM p
    WHERE seq % 13 = 6 AND NOT EXISTS (SELECT 1 FROM sd WHERE sd.route_id = p.route_id AND abs(sd.km * 1.2::DOUBLE - p.w) <= 0.02 + 1e-9)
), ps AS (
    SELECT route_id, seq, km, m, CASE WHEN route_id % 7 = 0 THEN 0 ELSE 5 + seq % 3 * 5 END AS minutes,
        m + coalesce(sum(CASE WHEN route_id % 7 = 0 THEN 0 ELSE 5 + seq % 3 * 5 END) OVER (PARTITION BY route_id ORDER BY km, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM p WHERE seq % 50 = 20
), al AS (
    SELECT route_id, kind, id, km, f, km * 4 + coalesce((SELECT sum(minutes) FROM ps WHERE ps.route_id = x.route_id AND ps.km < x.km - 1e-9), 0) AS elapsed FROM (SELECT * FROM sd UNION ALL SELECT * FROM mk) x
    UNION ALL SELECT route_id, 'pause-start', 'pause-' || seq || '-start', km, NULL, begins FROM ps WHERE minutes > 0
    UNION ALL SELECT route_id, 'pause-end', 'pause-' || seq || '-end', km, NULL, begins + minutes FROM ps WHERE minutes > 0
), tl AS (
    SELECT *, 480 + route_id % 60 + elapsed AS clock, row_number() OVER (PARTITION BY route_id ORDER BY elapsed, km, CASE kind WHEN 'route-start' THEN 0 WHEN 'gpx-end' THEN 1 WHEN 'gpx-start' THEN 2
        WHEN 'pause-start' THEN 4 WHEN 'pause-end' THEN 5 WHEN 'route-end' THEN 6 ELSE 3 END, id) AS position FROM al
)"""


def loop_files(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    position = F.expr("row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1").cast("int")
    at = lambda start, m: F.lit(start) + k % m * 0.01
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trip_id"), F.concat(F.lit("f"), k.cast("string")).alias("file_name"), k.alias("k"), position.alias("position"),
        at(45.0, 97).alias("lat1"), at(6.0, 89).alias("lon1"), at(45.0, 83).alias("lat2"), at(6.0, 79).alias("lon2"))


def rotated_loops(spark, sf_dir):
    files = loop_files(spark, sf_dir)
    first = files.where("trip_id % 3 <> 0").groupBy("trip_id").agg(F.max_by("file_name", "k").alias("file_name"))
    return waypoints.rotated(files.drop("k"), first)


def package_files(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents are files of the package of their source; a second state of it lacks some, has some changed and some more."""
    k = F.col("doc_id")
    files = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("-")).alias("package_id"), F.concat(F.lit("docs/"), k.cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content"), k)
    other = files.where("doc_id % 11 <> 0").withColumn("content", F.when(k % 7 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    return files, other.union(files.where("doc_id % 13 = 0").withColumn("path", F.concat(F.lit("extra/"), k.cast("string"))))


def package_hashes(spark, sf_dir):
    return packages.package_hashes(packages.manifest(package_files(spark, sf_dir)[0]))


def package_drift(spark, sf_dir):
    planned, existing = package_files(spark, sf_dir)
    return packages.drift(packages.manifest(planned), packages.manifest(existing))


def package_counts(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("day", "col", "passage", "override", "place", "lodging", "option")]), (k % 7 + 1).cast("int"))
    status = F.when(k % 7 == 0, F.when(k % 2 == 0, "ride").otherwise("off")).otherwise(F.element_at(F.array(*[F.lit(x) for x in ("matched", "needs-review", "unmatched")]), (k % 3 + 1).cast("int")))
    return packages.counts(o.select(F.col("o_custkey").alias("package_id"), kind.alias("kind"), status.alias("status")))


def payload_state(spark, sf_dir):
    """Orders of a customer are saves of a trip's files, some removed, some trips deleted."""
    k = F.col("o_orderkey")
    version = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    op = F.when(k % 41 == 0, "delete").when(k % 7 == 0, "remove").otherwise("put")
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("trip_id"), (k % 5).cast("string").alias("file_id"), version.alias("version"), op.alias("op"), k.cast("string").cast("binary").alias("content"))
    return payloads.current(payloads.compacted(log)).select("trip_id", "file_id", "version", F.col("content").cast("string").alias("content"))


def weather_samples_of(spark, sf_dir) -> DataFrame:
    """Orders of a customer are the days of a trip, with three waypoints each."""
    k = F.col("k")
    position = F.expr("row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1").cast("int")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trip_id"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("day_id"), position.alias("index"), F.col("o_orderkey").alias("k"))
    text = lambda p, m: F.when(k % m != 0, F.concat(F.lit(p), k.cast("string")))
    days = o.select("trip_id", "day_id", "index", F.when(k % 5 == 0, "off").when(k % 5 == 1, "transfer").otherwise("ride").alias("kind"), F.when(k % 17 != 0, F.date_add(F.lit("2024-01-01").cast("date"), F.col("index"))).alias("date"),
        text("n", 4).alias("name"), text("o", 3).alias("origin"), text("z", 8).alias("destination"))
    end = lambda up: F.struct((F.lit(45.0) + k % 50 * 0.01 + up).alias("latitude"), (F.lit(6.0) + k % 40 * 0.01).alias("longitude"), F.when(k % 6 != 0, (k % 900).cast("double")).alias("elevation_m"))
    ends = o.where("k % 5 > 1").select("trip_id", "day_id", end(0.0).alias("start"), end(0.5).alias("end"))
    j = F.col("j")
    kind = F.element_at(F.array(*[F.lit(x) for x in weather_days.ROLES]), ((k + j) % 9 + 1).cast("int"))
    points = o.withColumn("j", F.explode(F.array(*[F.lit(i) for i in range(3)]))).select(
        "day_id", F.concat(F.lit("w"), k.cast("string"), F.lit("-"), j.cast("string")).alias("waypoint_id"), F.concat(F.lit("p"), j.cast("string")).alias("name"), kind.alias("kind"), (F.lit(45.0) + k % 50 * 0.01 + j % 2 * 0.001).alias("latitude"),
        (F.lit(6.0) + k % 40 * 0.01).alias("longitude"), F.when(k % 9 != 0, (k % 900).cast("double")).alias("elevation_m"), F.when((k + j) % 13 != 0, (j * 60.0 + k % 60)).alias("elapsed_minutes"), ((k + j) % 4 != 0).alias("significant"),
    )
    return weather_days.definitions(days, ends, points)


def weather_samples(spark, sf_dir):
    return rounded(weather_samples_of(spark, sf_dir).withColumn("date", F.col("date").cast("string")), 4)


def weather_requests(spark, sf_dir):
    """Requests of two places at most, and what their answers bring back; every fifth place has none."""
    asked = weather_days.packed(weather_samples_of(spark, sf_dir).where("reason is null"), 2)
    answers = asked.where("pmod(length(key) + request + place, 5) <> 0").select("trip_id", "key", "request", "place", F.concat_ws(":", "key", "request", "place").alias("payload"))
    return weather_days.answered(asked, answers)


WEATHER_SQL = """wo AS (
    SELECT o_custkey AS trip_id, 'd' || o_orderkey AS day_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS i, o_orderkey AS k,
        CASE WHEN o_orderkey % 5 = 0 THEN 'off' WHEN o_orderkey % 5 = 1 THEN 'transfer' ELSE 'ride' END AS kind FROM orders
), wn AS (
    SELECT *, CASE WHEN k % 17 <> 0 THEN CAST(DATE '2024-01-01' + i AS VARCHAR) END AS date,
        max(CASE WHEN kind = 'ride' THEN i END) OVER (PARTITION BY trip_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bi,
        min(CASE WHEN kind = 'ride' THEN i END) OVER (PARTITION BY trip_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ai FROM wo
), wp AS (
    SELECT n.*, b.k AS bk, a.k AS ak FROM wn n LEFT JOIN wo b ON b.trip_id = n.trip_id AND b.i = n.bi LEFT JOIN wo a ON a.trip_id = n.trip_id AND a.i = n.ai WHERE n.date IS NOT NULL
), ww AS (SELECT k, j FROM wp, range(3) t(j) WHERE kind = 'ride' AND (k + j) % 4 <> 0 AND (k + j) % 13 <> 0),
ws AS (
    SELECT trip_id, day_id AS key, date, 'w' || k || '-' || j AS sample_id, 'p' || j AS name, ['start', 'end', 'col', 'col', 'summit', 'passage', 'passage', 'passage', 'pause'][(k + j) % 9 + 1] AS role,
        CASE WHEN j IS NOT NULL THEN round(45.0::DOUBLE + k % 50 * 0.01::DOUBLE + j % 2 * 0.001::DOUBLE, 4) END AS latitude, CASE WHEN j IS NOT NULL THEN round(6.0::DOUBLE + k % 40 * 0.01::DOUBLE, 4) END AS longitude,
        CASE WHEN j IS NULL OR k % 9 = 0 THEN 0.0::DOUBLE ELSE k % 900 END AS elevation_m, j * 60.0::DOUBLE + k % 60 AS elapsed_minutes, CASE WHEN j IS NULL THEN 'no-point' END AS reason FROM wp LEFT JOIN ww USING (k) WHERE kind = 'ride'
    UNION ALL
    SELECT trip_id, day_id, date, CASE WHEN k % 4 <> 0 AND x IS NOT NULL THEN day_id || ':off-location' END, CASE WHEN k % 4 <> 0 AND x IS NOT NULL THEN 'n' || k END, CASE WHEN k % 4 <> 0 AND x IS NOT NULL THEN 'off-location' END,
        CASE WHEN k % 4 <> 0 THEN round(45.0::DOUBLE + x % 50 * 0.01::DOUBLE + CASE WHEN bk IS NOT NULL THEN 0.5 ELSE 0 END, 4) END, CASE WHEN k % 4 <> 0 THEN round(6.0::DOUBLE + x % 40 * 0.01::DOUBLE, 4) END,
        CASE WHEN k % 4 <> 0 AND x IS NOT NULL THEN CASE WHEN x % 6 = 0 THEN 0 ELSE x % 900 END END, NULL, CASE WHEN k % 4 = 0 THEN 'place-unknown' WHEN x IS NULL THEN 'coordinates-unknown' END FROM (SELECT *, coalesce(bk, ak) AS x FROM wp WHERE kind = 'off')
    UNION ALL
    SELECT trip_id, day_id || '::origin', date, day_id || '::origin:location', 'o' || k, 'off-location', round(45.0::DOUBLE + bk % 50 * 0.01::DOUBLE + 0.5, 4), round(6.0::DOUBLE + bk % 40 * 0.01::DOUBLE, 4), CASE WHEN bk % 6 = 0 THEN 0 ELSE bk % 900 END, NULL, NULL
        FROM wp WHERE kind = 'transfer' AND k % 3 <> 0 AND bk IS NOT NULL
    UNION ALL
    SELECT trip_id, day_id || '::destination', date, day_id || '::destination:location', 'z' || k, 'off-location', round(45.0::DOUBLE + ak % 50 * 0.01::DOUBLE, 4), round(6.0::DOUBLE + ak % 40 * 0.01::DOUBLE, 4), CASE WHEN ak % 6 = 0 THEN 0 ELSE ak % 900 END, NULL, NULL
        FROM wp WHERE kind = 'transfer' AND k % 8 <> 0 AND ak IS NOT NULL
)"""
PACKAGE_SQL = """pf AS (SELECT coalesce(source, '-') AS package_id, 'docs/' || doc_id AS path, coalesce(text, '') AS content, doc_id FROM documents),
pe AS (
    SELECT package_id, path, content || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END AS content FROM pf WHERE doc_id % 11 <> 0 UNION ALL SELECT package_id, 'extra/' || doc_id, content FROM pf WHERE doc_id % 13 = 0
)"""

def climb_tile_profile(spark, sf_dir):
    """One climb a route, from its first hundred metres to its end."""
    series = track.cumulative(track_points(spark, sf_dir), "route_id").select("route_id", F.round("distance_km", 6).alias("distance_km"), F.round("elevation_m", 6).alias("elevation_m"))
    found = series.groupBy("route_id").agg(F.max("distance_km").alias("end_km")).select("route_id", F.lit(1).alias("number"), F.lit(0.1).alias("start_km"), "end_km")
    return rounded(climbs.tile_profile(found, series), 4)


def forecast_payloads(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Users are places, four of them a request; their events by hour are the answer, with faults planted by the user's number."""
    u = F.col("user_id")
    hour = F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd'T'HH:mm")
    h = table(spark, sf_dir, "events").groupBy("user_id", hour.alias("time")).agg(F.floor(F.avg("value")).cast("long").alias("v"), F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct("time", "v", "n")))
    places = h.groupBy("user_id").agg(rows.alias("r")).withColumn("r", F.when(u % 19 == 4, F.reverse("r")).otherwise(F.col("r")))
    listed = lambda c, r="r": F.concat(F.lit("["), F.array_join(F.transform(r, c), ","), F.lit("]"))
    times, temperature = listed(lambda x: F.concat(F.lit('"'), x["time"], F.lit('"'))), listed(lambda x: x["v"].cast("string"))
    short = F.when(u % 13 == 5, F.slice("r", 2, F.size("r"))).otherwise(F.col("r"))
    rain = F.concat(F.lit("["), F.array_join(F.transform(short, lambda x: F.when(x["n"] % 4 == 0, F.lit("null")).otherwise((x["n"] * 2).cast("string"))), ","), F.lit("]"))
    item = F.when(u % 17 == 7, F.lit('{"error":true,"reason":"x"}')).otherwise(F.concat(
        F.lit('{"latitude":45,"longitude":6,"timezone":"'), F.when(u % 23 == 2, "UTC").otherwise("Europe/Paris"), F.lit('"'), F.when(u % 7 != 2, F.concat(F.lit(',"location_id":'), (u % 4).cast("string"))).otherwise(F.lit("")),
        F.lit(',"hourly_units":{"temperature_2m":"°C","precipitation":"'), F.when(u % 11 == 3, "inch").otherwise("mm"), F.lit('"},"hourly":{"time":'), times, F.lit(',"temperature_2m":'), temperature, F.lit(',"precipitation":'), rain, F.lit("}}"),
    ))
    asked = places.select(F.floor(u / 4).alias("request"), (u % 4).cast("int").alias("place"), F.lit("Europe/Paris").alias("timezone"), item.alias("_item"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_item"))), lambda x: x["_item"]), ",")
    text = F.when(F.count("*") == 1, whole).otherwise(F.concat(F.lit("["), whole, F.lit("]")))
    return asked.groupBy("request").agg(text.alias("_t")).select("request", F.try_parse_json("_t").alias("payload")), asked.drop("_item")


def forecast_hours(spark, sf_dir):
    rows = forecasts.hours(forecasts.read(*forecast_payloads(spark, sf_dir)))
    return rows.select("request", "place", F.date_format("time", "yyyy-MM-dd HH").alias("hour"), "temperature_2m", "precipitation")


def forecast_issues(spark, sf_dir):
    """Reasons of places without an answer, and issues of the variables that are sent."""
    rows = forecasts.read(*forecast_payloads(spark, sf_dir))
    told = rows.select("request", "place", F.explode_outer("issues").alias("i")).where("i is not null").select("request", "place", "i.*").where("variable is null or variable in ('hourly.temperature_2m', 'hourly.precipitation')")
    return told.union(rows.where("reason is not null").select("request", "place", "reason", F.lit(None).cast("string")))


FORECAST_SQL = """h AS (
    SELECT user_id AS u, date_trunc('hour', ts) AS t, CAST(floor(avg(value)) AS BIGINT) AS v, count(*) AS n FROM events GROUP BY ALL
), p AS (SELECT u, count(*) AS hours FROM h GROUP BY u),
q AS (SELECT u, u // 4 AS request, CAST(u % 4 AS INT) AS place, hours, CASE WHEN u % 17 = 7 THEN 'provider-error' WHEN u % 19 = 4 AND hours > 1 THEN 'bad-hours' END AS reason FROM p)"""

QUERIES = {
    f.__name__: f
    for f in (climb_tile_profile, forecast_hours, forecast_issues, job_transitions, forecast_answers, timeline_assembly, timeline_issues, rotated_loops, package_hashes, package_drift, package_counts, payload_state, weather_samples, weather_requests)
}

SQL = {
    "climb_tile_profile": f"""
        WITH {STEPS_SQL}, s AS (SELECT route_id, round(distance_km, 6) AS km, round(elevation_m, 6) AS e FROM series), c AS (SELECT route_id, max(km) AS b FROM s GROUP BY 1),
        t AS (SELECT route_id, b, CAST(unnest(range(0, CAST(ceil((b - 0.1::DOUBLE - 1e-9) / 0.5::DOUBLE) AS INT))) AS INT) AS tile FROM c WHERE b > 0.1),
        u AS (SELECT route_id, tile, 0.1::DOUBLE + tile * 0.5::DOUBLE AS f, least(b, 0.1::DOUBLE + tile * 0.5::DOUBLE + 0.5) AS g FROM t),
        a AS (SELECT route_id, tile, 0 AS side, f AS at_km FROM u UNION ALL SELECT route_id, tile, 1, g FROM u),
        n AS (SELECT a.*, (SELECT max(km) FROM s WHERE s.route_id = a.route_id AND km < at_km) AS k0, (SELECT min(km) FROM s WHERE s.route_id = a.route_id AND km >= at_km) AS k1 FROM a),
        v AS (
            SELECT n.*, coalesce(x.e, y.e) + (coalesce(y.e, x.e) - coalesce(x.e, y.e)) * CASE WHEN y.km - x.km <= 1e-9 THEN 0 ELSE greatest(0.0, least(1.0, (at_km - x.km) / (y.km - x.km))) END AS e
            FROM n LEFT JOIN s x ON x.route_id = n.route_id AND x.km = coalesce(k0, k1) LEFT JOIN s y ON y.route_id = n.route_id AND y.km = coalesce(k1, k0)
        ), w AS (SELECT u.*, p.e AS from_m, q.e AS to_m FROM u JOIN v p ON p.route_id = u.route_id AND p.tile = u.tile AND p.side = 0 JOIN v q ON q.route_id = u.route_id AND q.tile = u.tile AND q.side = 1),
        x AS (SELECT *, CASE WHEN g - f > 1e-9 THEN (to_m - from_m) / ((g - f) * 1000) * 100 END AS grade FROM w)
        SELECT route_id, 1 AS number, tile, round(f, 4) + 0.0 AS from_km, round(g, 4) + 0.0 AS to_km, round(from_m, 4) + 0.0 AS from_m, round(to_m, 4) + 0.0 AS to_m, round(grade, 4) + 0.0 AS grade,
            CASE WHEN grade < -7 THEN 'descent-7-plus' WHEN grade < 0 THEN 'descent-0-7' WHEN grade < 1 THEN 'climb-0-1' WHEN grade < 4 THEN 'climb-1-4' WHEN grade < 8 THEN 'climb-4-8' WHEN grade < 12 THEN 'climb-8-12'
                WHEN grade IS NOT NULL THEN 'climb-12-plus' END AS grade_class FROM x""",
    "forecast_hours": f"""
        WITH {FORECAST_SQL} SELECT request, place, strftime(t, '%Y-%m-%d %H') AS hour, CAST(v AS DOUBLE) AS temperature_2m,
            CASE WHEN u % 13 <> 5 AND u % 11 <> 3 AND n % 4 <> 0 THEN CAST(n * 2 AS DOUBLE) END AS precipitation FROM h JOIN q USING (u) WHERE reason IS NULL""",
    "forecast_issues": f"""
        WITH {FORECAST_SQL} SELECT request, place, reason AS code, NULL AS variable FROM q WHERE reason IS NOT NULL
        UNION ALL SELECT request, place, 'bad-days', NULL FROM q WHERE reason IS NULL UNION ALL SELECT request, place, 'other-timezone', NULL FROM q WHERE reason IS NULL AND u % 23 = 2
        UNION ALL SELECT request, place, 'unit', 'hourly.precipitation' FROM q WHERE reason IS NULL AND u % 11 = 3
        UNION ALL SELECT request, place, 'column', 'hourly.precipitation' FROM q WHERE reason IS NULL AND (u % 11 = 3 OR u % 13 = 5)""",
    "job_transitions": """
        WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events), l AS (
            SELECT user_id * 1000 + n // 8 AS job_id, event_id AS seq, n % 8 AS k, CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 11 = 0 THEN 'pending'
                ELSE ['pending', 'parsing', 'validating', 'writing', 'ready'][n % 8 % 5 + 1] END AS asked, CASE WHEN event_id % 4 <> 0 THEN floor(value) / 1000 END AS p,
                CASE WHEN event_id % 7 = 0 THEN 'e' || (event_id % 9) END AS e FROM n
        ), r AS (
            SELECT job_id, seq, k, CAST(NULL AS VARCHAR) AS before, asked, asked = 'pending' AS legal, CASE WHEN asked = 'pending' THEN asked END AS status, CASE WHEN asked = 'pending' THEN p END AS progress,
                CASE WHEN asked = 'pending' THEN e END AS error FROM l WHERE k = 0
            UNION ALL
            SELECT job_id, seq, k, before, asked, ok, CASE WHEN ok THEN asked ELSE before END, CASE WHEN ok THEN coalesce(p, progress) ELSE progress END, CASE WHEN ok THEN coalesce(e, error) ELSE error END FROM (
                SELECT l.*, r.status AS before, r.progress, r.error, coalesce((r.status IS NULL AND l.asked = 'pending') OR (r.status || '>' || l.asked) IN ('pending>parsing', 'parsing>validating', 'validating>writing', 'writing>ready',
                    'pending>failed', 'parsing>failed', 'validating>failed', 'writing>failed'), false) AS ok FROM r JOIN l ON l.job_id = r.job_id AND l.k = r.k + 1)
        )
        SELECT job_id, seq, before, asked, legal, status, round(progress, 6) + 0.0 AS progress, error FROM r""",
    "forecast_answers": """
        WITH e AS (SELECT user_id AS request, event_id AS seq, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 'p' || event_id END AS p FROM events),
        l AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY ts, p IS NULL, seq) AS n FROM e),
        a AS (SELECT x.*, max(y.n) AS last FROM l x LEFT JOIN l y ON y.request = x.request AND y.p IS NOT NULL AND y.n < x.n WHERE x.p IS NULL GROUP BY ALL),
        b AS (SELECT a.*, y.p AS payload, epoch_us(a.ts - y.ts) / 60e6 AS age FROM a LEFT JOIN l y ON y.request = a.request AND y.n = a.last),
        c AS (SELECT *, CASE WHEN age IS NULL OR age > 1440 THEN 'miss' WHEN age <= 600 THEN 'fresh' ELSE 'stale' END AS state FROM b),
        d AS (SELECT *, state <> 'fresh' AND row_number() OVER (PARTITION BY request, last, state ORDER BY n) = 1 AS "fetch" FROM c)
        SELECT request, seq, state, "fetch", CASE WHEN state <> 'miss' THEN payload END AS payload, CASE WHEN state <> 'miss' THEN round(age, 4) + 0.0 END AS age_minutes FROM d""",
    "timeline_assembly": f"WITH {TIMELINE_SQL} SELECT route_id, id AS waypoint_id, kind, position, round(km, 6) + 0.0 AS km, round(elapsed, 6) + 0.0 AS elapsed_minutes, round(clock, 6) + 0.0 AS clock_minutes FROM tl",
    "timeline_issues": f"""
        WITH {TIMELINE_SQL}, o AS (
            SELECT route_id, kind, id, position, elapsed, km + CASE WHEN route_id % 10 = 7 AND kind = 'route-end' THEN -1.0::DOUBLE WHEN route_id % 10 = 8 AND kind = 'gpx-start' THEN 0.001::DOUBLE ELSE 0 END AS km FROM tl
            WHERE NOT (route_id % 10 = 4 AND kind = 'route-end')
        ), b AS (SELECT *, elapsed + 1e-9 < lag(elapsed) OVER w OR km + 1e-9 < lag(km) OVER w AS back FROM o WINDOW w AS (PARTITION BY route_id ORDER BY position)),
        n AS (SELECT route_id, count(*) AS n FROM fl GROUP BY 1)
        SELECT route_id, 'route-start-0' AS waypoint_id, 'duplicate-id' AS code FROM o WHERE route_id % 10 = 1 AND kind = 'gpx-start'
        UNION ALL SELECT route_id, CASE WHEN route_id % 10 = 1 AND kind = 'gpx-start' THEN 'route-start-0' ELSE id END, 'not-ordered' FROM b WHERE back
        UNION ALL SELECT route_id, id, 'not-finite' FROM o WHERE route_id % 10 = 6 AND kind = 'route-start'
        UNION ALL SELECT route_id, NULL, unnest(CASE route_id % 10 WHEN 2 THEN ['pause-sum'] WHEN 3 THEN ['total-mismatch'] WHEN 4 THEN ['wrong-ends'] WHEN 5 THEN ['files-missing'] WHEN 8 THEN CASE WHEN n > 1 THEN ['files-apart'] ELSE [] END ELSE [] END) FROM n""",
    "rotated_loops": f"""
        WITH f AS (
            SELECT o_custkey AS trip_id, 'f' || o_orderkey AS file_name, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS p, count(*) OVER (PARTITION BY o_custkey) AS n,
                45.0::DOUBLE + o_orderkey % 97 * 0.01::DOUBLE AS a, 6.0::DOUBLE + o_orderkey % 89 * 0.01::DOUBLE AS b, 45.0::DOUBLE + o_orderkey % 83 * 0.01::DOUBLE AS c, 6.0::DOUBLE + o_orderkey % 79 * 0.01::DOUBLE AS d FROM orders
        ), s AS (SELECT f.*, CASE WHEN f.trip_id % 3 <> 0 THEN m.p END AS s FROM f JOIN (SELECT trip_id, arg_max(p, k) AS p FROM f GROUP BY 1) m USING (trip_id)),
        o AS (
            SELECT *, (p - coalesce(s, 0) + n) % n AS pos, 'forward' AS direction FROM s UNION ALL SELECT *, (s - p + n) % n, 'backward' FROM s WHERE s IS NOT NULL
        ), g AS (SELECT *, {hav("lag(c) OVER w", "lag(d) OVER w", "a", "b")} AS gap FROM o WINDOW w AS (PARTITION BY trip_id, direction ORDER BY pos)),
        t AS (SELECT trip_id, coalesce(sum(gap) FILTER (direction = 'backward') < sum(gap) FILTER (direction = 'forward') - 1e-9, false) AS turn FROM g GROUP BY 1)
        SELECT trip_id, file_name, CAST(pos AS INT) AS position, direction FROM o JOIN t USING (trip_id) WHERE direction = CASE WHEN turn THEN 'backward' ELSE 'forward' END""",
    "package_hashes": f"""
        WITH {PACKAGE_SQL}, h AS (SELECT package_id, strlen(content) AS b, sha256(path || chr(10) || strlen(content) || chr(10) || sha256(content)) AS h FROM pf),
        s AS (SELECT package_id, count(*) AS files, CAST(sum(b) AS BIGINT) AS bytes, {', '.join(f"CAST(sum(CAST('0x' || substr(h, {15 * i + 1}, 15) AS BIGINT)) % 1152921504606846976 AS BIGINT) AS l{i}" for i in range(4))} FROM h GROUP BY 1)
        SELECT package_id, files, bytes, {' || '.join(f"lpad(lower(to_hex(l{i})), 15, '0')" for i in range(4))} AS content_hash FROM s""",
    "package_drift": f"""
        WITH {PACKAGE_SQL} SELECT coalesce(a.package_id, b.package_id) AS package_id, coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'extra' ELSE 'different' END AS state
        FROM pf a FULL JOIN pe b ON a.package_id = b.package_id AND a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.content <> b.content""",
    "package_counts": """
        SELECT o_custkey AS package_id, count(*) FILTER (o_orderkey % 7 = 0) AS days, count(*) FILTER (o_orderkey % 14 = 0) AS ride_days, count(*) FILTER (o_orderkey % 7 = 0 AND o_orderkey % 2 = 1) AS off_days,
            count(*) FILTER (o_orderkey % 7 IN (1, 2, 6)) AS candidates, count(*) FILTER (o_orderkey % 7 = 3) AS overrides, count(*) FILTER (o_orderkey % 7 = 3 AND o_orderkey % 3 = 0) AS matched,
            count(*) FILTER (o_orderkey % 7 = 3 AND o_orderkey % 3 = 1) AS needs_review, count(*) FILTER (o_orderkey % 7 = 3 AND o_orderkey % 3 = 2) AS unmatched, count(*) FILTER (o_orderkey % 7 = 4) AS places,
            count(*) FILTER (o_orderkey % 7 = 5) AS lodgings FROM orders GROUP BY 1""",
    "payload_state": """
        WITH l AS (
            SELECT CAST(o_custkey AS VARCHAR) AS trip_id, CAST(o_orderkey % 5 AS VARCHAR) AS file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, CAST(o_orderkey AS VARCHAR) AS content,
                CASE WHEN o_orderkey % 41 = 0 THEN 'delete' WHEN o_orderkey % 7 = 0 THEN 'remove' ELSE 'put' END AS op FROM orders
        )
        SELECT trip_id, file_id, version, content FROM l WHERE op = 'put' AND NOT EXISTS (SELECT 1 FROM l m WHERE m.trip_id = l.trip_id AND m.version > l.version AND (m.op = 'delete' OR m.file_id = l.file_id))""",
    "weather_samples": f"WITH {WEATHER_SQL} SELECT * FROM ws",
    "weather_requests": f"""
        WITH {WEATHER_SQL}, g AS (SELECT trip_id, key, latitude, longitude, list(sample_id ORDER BY sample_id) AS s FROM ws WHERE reason IS NULL GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (PARTITION BY trip_id, key ORDER BY s[1]) - 1 AS n FROM g)
        SELECT trip_id, key, unnest(s) AS sample_id, CASE WHEN (length(key) + n // 2 + n % 2) % 5 <> 0 THEN key || ':' || (n // 2) || ':' || (n % 2) END AS payload,
            CASE WHEN (length(key) + n // 2 + n % 2) % 5 <> 0 THEN 'available' ELSE 'missing' END AS state FROM n""",
}
