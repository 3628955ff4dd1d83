"""Queries of whole stages and trips (waypoints with times, assembled documents) over the driver's tables, with their SQL (DuckDB)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.operators import assembly, itinerary, track
from trailframe.plans.carriers import POINTS_SQL, hav, table, track_points
from trailframe.plans.oracle import DISPLAY_SQL, FACTOR, MULTIPLIER, PRIORITY, at_sql
from trailframe.plans.queries import rounded, series

KINDS = ("mountain-pass", "city", "saddle", "village", "town", "peak")


def stage_parts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Every route is a stage; some of its points are places, others the tops of climbs."""
    line = series(spark, sf_dir)
    r, s, km = F.col("route_id"), F.col("seq"), F.round("distance_km", 4)
    stages = line.groupBy("route_id").agg(F.count("*").alias("_n")).select(
        r, F.when(r % 4 != 0, F.concat(F.lit("Vîlle "), (r % 3).cast("string"))).alias("start_name"), F.when(r % 5 != 0, F.lit("BOURG 2")).alias("end_name"), (r % 7 * 13).alias("pause_minutes"),
        F.when(r % 6 == 0, "custom").when(r % 6 == 1, "automatic").alias("mode"), F.format_string("%02d:%02d", r % 24, r * 7 % 60).alias("departure"), (r % 2 == 0).alias("mountains"),
    )
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (s % 6 + 1).cast("int"))
    name = F.when(kind.isin("mountain-pass", "saddle", "peak"), F.concat(F.lit("Còl "), F.floor(s / 30).cast("string"))).when(kind == "town", F.lit("Bourg-2")).otherwise(F.concat(F.lit("ville "), (s % 3).cast("string")))
    points = line.where("seq % 4 = 1 or seq % 11 = 0").select(
        "route_id", (r * 100_000 + s).alias("point_id"), kind.alias("kind"), F.when(s % 13 != 5, name).alias("name"), F.when(s % 17 != 4, km).alias("track_km"),
        F.when(s % 3 != 0, F.col("latitude") + 0.001).alias("latitude"), F.when(s % 3 != 0, F.col("longitude")).alias("longitude"), F.when(s % 5 == 0, 700.0 + s).alias("elevation_m"),
    )
    climbs = line.where("seq % 10 = 7").select(
        "route_id", (r * 100_000 + s).alias("climb_id"), F.when(s % 20 == 7, F.concat(F.lit("COL "), F.floor(s / 30).cast("string"))).when(s % 40 == 17, F.lit("Bosse")).alias("name"),
        F.greatest(km - s % 4 * 0.6, F.lit(0.0)).alias("start_km"), km.alias("end_km"), (s * 9.0).alias("gain_m"), (s % 9).cast("double").alias("average_grade"), (900.0 + s).alias("end_m"), (s % 20 == 7).alias("confirmed"),
    )
    return stages, line, points, climbs


def by_route(stages: DataFrame, rows: DataFrame) -> DataFrame:
    """The country's kind at the climbs of a route."""
    return rows.join(stages.select("route_id", "mountains"), "route_id")


def canonical_waypoints(spark, sf_dir):
    stages, line, points, climbs = stage_parts(spark, sf_dir)
    return rounded(itinerary.canonical_waypoints(stages, line, points, by_route(stages, climbs), F.col("mountains")).withColumn("climb_id", F.col("climb_id").cast("string")), 6)


def stage_itineraries(spark, sf_dir):
    """Custom stages pause at every place whose number asks for it, and at one that doesn't exist."""
    stages, line, points, climbs = stage_parts(spark, sf_dir)
    n = F.col("point_id") % 100_000
    custom = points.where(n % 8 == 1).select("route_id", F.concat(F.lit("place-"), "point_id").alias("waypoint_id"), (n % 3 * 10 + 5).alias("minutes"))
    rows = itinerary.stage_waypoints(stages, line, points, by_route(stages, climbs), custom, mountains=F.col("mountains"))
    return rounded(rows.drop("latitude", "longitude").withColumn("climb_id", F.col("climb_id").cast("string")), 6)


def trip_files(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A customer is a trip, an order a file of it, the lines of an order its places and climbs."""
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    trips = table(spark, sf_dir, "customer").select(
        c.alias("trip_id"), F.when(c % 3 != 0, F.date_add(F.lit("2024-02-20").cast("date"), (c % 20).cast("int"))).alias("start_date"), F.concat(F.lit("trip-"), c.cast("string")).alias("slug"), F.col("c_name").alias("name"),
        F.lit("Europe/Paris").alias("timezone"), F.lit("fr").alias("language"), F.lit("metric").alias("units"), F.lit("08:30").alias("departure"), (c % 9 + 14.0).alias("reference_kph"), (c % 2 == 0).alias("mountains"),
        F.lit("2024-01-05T06:07:08Z").alias("imported_at"), F.lit("engine@1").alias("engine"),
    )
    moving = F.when(k % 5 != 0, k % 30_000 + 600)
    files = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("trip_id"), F.col("o_orderdate").alias("position"), k.alias("route_id"), F.when(k % 4 != 0, F.concat(F.lit("Etape "), k.cast("string"))).alias("name"),
        F.when(k % 7 == 0, "partial").otherwise("success").alias("status"), F.when(k % 11 != 0, k % 900 / 10).alias("distance_km"), F.when(k % 11 != 0, (k % 2000).cast("double")).alias("gain_m"),
        F.when(k % 11 != 0, (k % 1900).cast("double")).alias("loss_m"), (k % 500).cast("double").alias("min_m"), (k % 500 + 800.0).alias("max_m"), moving.alias("moving_s"), F.when(k % 5 != 0, k % 90 * 60).alias("pause_s"),
        (moving + k % 90 * 60).alias("total_s"), F.when(k % 5 != 0, 12.5).alias("average_kph"), F.concat(k.cast("string"), F.lit(".gpx")).alias("file_name"), F.lit("application/gpx+xml").alias("mime_type"),
        (k % 5000).alias("bytes"), F.sha2(k.cast("string"), 256).alias("sha256"),
    )
    n, i = F.col("l_linenumber"), (F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route_id"), n.alias("n"), (8 - n).alias("ordinal"), i.alias("id"), F.col("l_quantity").alias("q")).dropDuplicates(["route_id", "n"])
    q = F.col("q").cast("double")
    points = lines.where("n % 2 = 1").select("route_id", "ordinal", F.col("id").alias("point_id"), F.lit("summit").alias("kind"), F.lit("P").alias("name"), (q + 1).alias("latitude"), q.alias("longitude"), F.lit(None).cast("double").alias("elevation_m"), q.alias("track_km"))
    climbs = lines.where("n % 2 = 0").select(
        "route_id", "ordinal", F.col("id").alias("climb_id"), F.lit(None).cast("string").alias("name"), q.alias("start_km"), (q + 2).alias("end_km"), (q * 3).alias("gain_m"), F.lit(4.0).alias("average_grade"),
        F.lit(None).cast("double").alias("max_grade"), F.lit(None).cast("double").alias("start_m"), F.lit(None).cast("double").alias("end_m"),
    )
    return trips, files, points, climbs


def built_stages(spark, sf_dir):
    trips, files, points, climbs = trip_files(spark, sf_dir)
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    rows = assembly.built_stages(files, trips, points, climbs)
    return rows.select("trip_id", "stage_id", "day_id", "index", "display_number", F.col("date").cast("string").alias("date"), "name", "start_name", "end_name", "total_s", "validation", ids("point_ids"), ids("climb_ids"))


def assembled_trips(spark, sf_dir):
    """What the documents say, read back from them."""
    documents = assembly.assembled(*(trip_files(spark, sf_dir)[i] for i in (0, 1, 2, 3)))
    read = lambda path, kind, name: F.variant_get("document", path, kind).alias(name)
    size = lambda name: F.size(F.variant_get("document", f"$.{name}", "array<struct<id:string>>")).alias(f"n_{name}")
    breaks = F.aggregate(F.variant_get("document", "$.settings.days", "array<struct<totalBreakSeconds:bigint>>"), F.lit(0).cast("long"), lambda acc, d: acc + F.coalesce(d["totalBreakSeconds"], F.lit(0)))
    last = F.expr("try_element_at(variant_get(document, '$.stages', 'array<struct<sourceRouteId:string,climbIds:array<string>>>'), -1)")
    return documents.select(
        "trip_id", read("$.metadata.status", "string", "status"), read("$.calendar.startDate", "string", "start_date"), read("$.metadata.endDate", "string", "end_date"), read("$.metadata.timezone", "string", "timezone"),
        read("$.settings.global.referenceSpeedKph", "double", "reference_kph"), *(size(n) for n in ("days", "stages", "routes", "climbs", "routePoints", "weather")), breaks.alias("break_s"),
        last["sourceRouteId"].alias("last_route"), F.array_join(last["climbIds"], ",").alias("last_climbs"),
    )


def chained_points(spark, sf_dir) -> DataFrame:
    """The routes of a chain are the files of a trip; some file numbers are left out."""
    r, c = F.col("route_id"), F.col("chain")
    return track_points(spark, sf_dir).select(c.alias("trip_id"), (r + F.when((c % 3 == 0) & (r % 5 > 2), 1).otherwise(0)).alias("file_number"), "segment_index", "seq", "latitude", "longitude", "elevation_m")


def joined_profiles(spark, sf_dir):
    return rounded(track.joined_profile(chained_points(spark, sf_dir)).drop("latitude", "longitude", "elevation_m"), 4)


def joined_summaries(spark, sf_dir):
    """The tolerance is wide, so that both answers occur."""
    return rounded(track.joined_summary(track.joined_profile(chained_points(spark, sf_dir)), 3.2), 4)


QUERIES = {f.__name__: f for f in (canonical_waypoints, stage_itineraries, built_stages, assembled_trips, joined_profiles, joined_summaries)}



def key(name: str) -> str:
    return f"nullif(regexp_replace(lower(strip_accents({name})), '[^a-z0-9]+', '', 'g'), '')"


def large(profiles) -> str:
    return " OR ".join(f"(e - s >= {km} AND gain >= {gain} AND grade >= {grade})" for km, gain, grade in profiles)


PARTS_SQL = f"""{DISPLAY_SQL}, st AS (
    SELECT route_id, CASE WHEN route_id % 4 <> 0 THEN 'Vîlle ' || (route_id % 3) END AS sn, CASE WHEN route_id % 5 <> 0 THEN 'BOURG 2' END AS en, route_id % 7 * 13 AS brk, route_id % 6 = 0 AS custom,
        route_id % 24 * 60 + route_id * 7 % 60 AS dep, route_id % 2 = 0 AS mountains, max(distance_km) AS total, {", ".join(f"{side}({c} ORDER BY seq) AS {side}_{c}" for side in ("first", "last") for c in ("latitude", "longitude", "elevation_m"))}
    FROM series GROUP BY route_id
), pk AS (
    SELECT *, [{", ".join(f"'{k}'" for k in KINDS)}][seq % 6 + 1] AS kind FROM series WHERE seq % 4 = 1 OR seq % 11 = 0
), pt AS (
    SELECT route_id, seq, route_id * 100000 + seq AS id, kind, CASE WHEN seq % 13 <> 5 THEN CASE WHEN kind IN ('mountain-pass', 'saddle', 'peak') THEN 'Còl ' || (seq // 30) WHEN kind = 'town' THEN 'Bourg-2' ELSE 'ville ' || (seq % 3) END END AS name,
        CASE WHEN seq % 17 <> 4 THEN round(distance_km, 4) END AS km, CASE WHEN seq % 3 <> 0 THEN latitude + 0.001::DOUBLE END AS la, CASE WHEN seq % 3 <> 0 THEN longitude END AS lo, CASE WHEN seq % 5 = 0 THEN 700.0::DOUBLE + seq END AS el FROM pk
), cb AS (
    SELECT route_id, route_id * 100000 + seq AS id, CASE WHEN seq % 20 = 7 THEN 'COL ' || (seq // 30) WHEN seq % 40 = 17 THEN 'Bosse' END AS name, greatest(round(distance_km, 4) - seq % 4 * 0.6::DOUBLE, 0.0) AS s, round(distance_km, 4) AS e,
        seq * 9.0::DOUBLE AS gain, seq % 9 AS grade, 900.0::DOUBLE + seq AS el, seq % 20 = 7 AS confirmed FROM series WHERE seq % 10 = 7
), ck AS (SELECT route_id, {key("name")} AS key, list({{'km': e, 'id': id}} ORDER BY e, id) AS cs FROM cb WHERE name IS NOT NULL GROUP BY ALL),
mk AS (
    SELECT route_id, {key("name")} AS key, list({{'p': CASE kind WHEN 'mountain-pass' THEN 1 ELSE 2 END, 'km': km, 'id': id}}) AS ms FROM pt
    WHERE kind IN ('mountain-pass', 'saddle') AND km IS NOT NULL AND name IS NOT NULL GROUP BY ALL
), gd AS (
    SELECT route_id, key, cs, ms, 0 AS n, CAST([] AS BIGINT[]) AS a FROM ck JOIN mk USING (route_id, key)
    UNION ALL
    SELECT route_id, key, cs, ms, n + 1, list_append(a, coalesce(list_min(list_transform(list_filter(ms, lambda m: abs(m.km - cs[n + 1].km) <= 1 AND NOT list_contains(a, m.id)),
        lambda m: {{'p': m.p, 'far': abs(m.km - cs[n + 1].km), 'id': m.id}})).id, -1)) FROM gd WHERE n < len(cs)
), met AS (SELECT * FROM (SELECT route_id, unnest(cs).id AS climb_id, unnest(a) AS point_id FROM gd WHERE n = len(cs)) WHERE point_id >= 0),
w0 AS (
    SELECT route_id, 'start' AS waypoint_id, 'start' AS kind, 'major' AS importance, coalesce(sn, 'Départ') AS name, 0.0::DOUBLE AS km, first_latitude AS la, first_longitude AS lo, first_elevation_m AS el, CAST(NULL AS BIGINT) AS climb_id FROM st
    UNION ALL SELECT route_id, 'end', 'end', 'major', coalesce(en, 'Arrivée'), total, last_latitude, last_longitude, last_elevation_m, NULL FROM st
    UNION ALL SELECT p.route_id, 'place-' || id, kind, CASE kind WHEN 'village' THEN 'secondary' ELSE 'major' END, name, km, la, lo, el, climb_id
    FROM pt p JOIN st USING (route_id) LEFT JOIN met ON met.route_id = p.route_id AND met.point_id = p.id WHERE kind <> 'peak' AND km IS NOT NULL
        AND NOT (kind IN ('city', 'town', 'village') AND coalesce({key("name")} = {key("sn")} AND km <= 2 OR {key("name")} = {key("en")} AND km >= total - 2, false))
    UNION ALL SELECT c.route_id, 'climb-' || id, 'climb', CASE WHEN confirmed AND name IS NOT NULL OR CASE WHEN mountains THEN {large(((4, 300, 3), (1.5, 150, 6)))} ELSE {large(((1.5, 100, 2), (1, 60, 3), (0.5, 40, 4)))} END THEN 'major' ELSE 'secondary' END,
        coalesce(name, 'Montée'), e, NULL, NULL, el, id FROM cb c JOIN st USING (route_id) WHERE id NOT IN (SELECT climb_id FROM met)
)"""


def located(source: str, to: str, more: str = "") -> str:
    """CTEs: position, coordinates and heights of waypoints."""

    def at(own: str, c: str) -> str:
        return f"coalesce({own}, coalesce(x.{c}, y.{c}) + (coalesce(y.{c}, x.{c}) - coalesce(x.{c}, y.{c})) * CASE WHEN y.distance_km - x.distance_km <= 1e-9 THEN 0.0 ELSE greatest(0.0, least(1.0, (p.km - x.distance_km) / (y.distance_km - x.distance_km))) END)"

    return f"""{to}_p AS (
        SELECT w.*, CAST(row_number() OVER (PARTITION BY route_id ORDER BY km, {PRIORITY}, waypoint_id) AS INT) AS position, (SELECT max(s.distance_km) FROM series s WHERE s.route_id = w.route_id AND s.distance_km < w.km) AS d0,
            (SELECT min(s.distance_km) FROM series s WHERE s.route_id = w.route_id AND s.distance_km >= w.km) AS d1 FROM {source} w
    ), {to} AS (
        SELECT p.route_id, p.position, p.waypoint_id, p.kind, p.importance, p.name, p.km, {at("p.la", "latitude")} AS latitude, {at("p.lo", "longitude")} AS longitude,
            CASE WHEN p.kind IN ('start', 'end') THEN p.el ELSE {at("p.el", "elevation_m")} END AS elevation_m, p.climb_id{more}
        FROM {to}_p p JOIN series x ON x.route_id = p.route_id AND x.distance_km = coalesce(p.d0, p.d1) JOIN series y ON y.route_id = p.route_id AND y.distance_km = coalesce(p.d1, p.d0))"""


def placed(i: int) -> str:
    """CTE p<i>: the i-th automatic pause at the best waypoint that the earlier ones leave."""
    free = " ".join(f"AND NOT EXISTS (SELECT 1 FROM p{j} q WHERE q.route_id = c.route_id AND (abs(q.km - c.km) < total * 0.08::DOUBLE OR q.id = c.waypoint_id))" for j in range(i))
    return f"""p{i} AS (SELECT i.route_id, i.pos, i.minutes, coalesce(b.km, least(greatest(i.km, total * 0.08::DOUBLE), total - total * 0.08::DOUBLE)) AS km, b.waypoint_id AS id FROM ideal i LEFT JOIN (
        SELECT c.*, row_number() OVER (PARTITION BY c.route_id ORDER BY p, abs(c.km - i.km), waypoint_id) AS z FROM c JOIN ideal i ON i.route_id = c.route_id AND i.pos = {i}
        WHERE c.km >= total * 0.08::DOUBLE AND c.km <= total - total * 0.08::DOUBLE AND abs(c.km - i.km) <= total * 0.12::DOUBLE {free}
    ) b ON b.route_id = i.route_id AND b.z = 1 WHERE i.pos = {i})"""


TIMES_SQL = f"""profile AS (
    SELECT sm.route_id, sm.k, sm.distance_km, CASE WHEN rk.t - lk.t <= 1e-9 THEN 0.0 ELSE greatest(-20.0::DOUBLE, least(20.0::DOUBLE, (rv.v - lv.v) / ((rk.t - lk.t) * 1000) * 100)) END AS grade
    FROM sm JOIN lk USING (route_id, k) JOIN rk USING (route_id, k) JOIN lv USING (route_id, k) JOIN rv USING (route_id, k)
), fk AS (SELECT *, greatest(-15.0::DOUBLE, least(15.0::DOUBLE, coalesce(grade, 0.0))) AS g FROM profile), f AS (SELECT *, {FACTOR} AS factor FROM fk),
m AS (
    SELECT *, coalesce(greatest(0.0, distance_km - lag(distance_km) OVER w) / greatest(3.0, least(55.0, 18.0 * greatest(0.1, (lag(factor) OVER w + factor) / 2))) * 60, 0.0) AS step FROM f WINDOW w AS (PARTITION BY route_id ORDER BY k)
), timed AS (SELECT *, sum(step) OVER (PARTITION BY route_id ORDER BY k) AS moving_minutes FROM m)"""
ITINERARY_SQL = f"""{PARTS_SQL}, c AS (
    SELECT *, CASE kind WHEN 'city' THEN 0 WHEN 'town' THEN 1 WHEN 'village' THEN 2 ELSE 3 END AS p FROM w0 WHERE kind IN ('city', 'town', 'village', 'mountain-pass', 'saddle')
), ie AS (SELECT route_id, total, brk, pos, name, total * part AS km, brk * share AS ex FROM st, (VALUES (0, 'morning', 0.25::DOUBLE, 0.25::DOUBLE), (1, 'main', 0.5, 0.5), (2, 'afternoon', 0.75, 0.25)) r(pos, name, part, share) WHERE NOT custom AND brk > 0),
ideal AS (SELECT * FROM (
    SELECT *, CAST(floor(ex) AS BIGINT) + CASE WHEN row_number() OVER (PARTITION BY route_id ORDER BY ex - floor(ex) DESC, pos) <= brk - sum(floor(ex)) OVER (PARTITION BY route_id) THEN 1 ELSE 0 END AS minutes FROM ie) WHERE minutes > 0),
{placed(0)}, {placed(1)}, {placed(2)}, pz AS (
    SELECT p.route_id, p.km, p.minutes, id, name FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2) p JOIN ie USING (route_id, pos)
    UNION ALL SELECT w0.route_id, w0.km, seq % 3 * 10 + 5, waypoint_id, w0.name FROM pt JOIN st ON st.route_id = pt.route_id AND custom JOIN w0 ON w0.route_id = pt.route_id AND waypoint_id = 'place-' || id WHERE seq % 8 = 1
), w1 AS (
    SELECT w0.*, pm FROM w0 LEFT JOIN (SELECT route_id, id, CAST(sum(minutes) AS BIGINT) AS pm FROM pz WHERE id IS NOT NULL GROUP BY ALL) q ON q.route_id = w0.route_id AND q.id = w0.waypoint_id
    UNION ALL SELECT route_id, 'pause-' || name, 'pause', 'minor', name, km, NULL, NULL, NULL, NULL, minutes FROM pz WHERE id IS NULL
), {located("w1", "wl", ", p.pm")}, {TIMES_SQL}, ak AS (SELECT route_id, position AS k, km AS t FROM wl), {at_sql("timed", "moving_minutes", "ak", "mv")},
ee AS (
    SELECT wl.*, mv.v AS moving, mv.v + coalesce((SELECT sum(minutes) FROM pz WHERE pz.route_id = wl.route_id AND pz.km + 1e-9 <= wl.km), 0) AS elapsed, dep FROM wl JOIN mv ON mv.route_id = wl.route_id AND mv.k = wl.position JOIN st ON st.route_id = wl.route_id
), ct AS (SELECT *, CAST(floor(dep + elapsed + 0.5) AS BIGINT) AS tm FROM ee)"""
JOINED_SQL = f"""{POINTS_SQL}, cp AS (SELECT chain AS trip_id, route_id + CASE WHEN chain % 3 = 0 AND route_id % 5 > 2 THEN 1 ELSE 0 END AS file_number, segment_index, seq, latitude, longitude, elevation_m FROM track_points),
sg AS (
    SELECT *, coalesce({hav("lag(latitude) OVER w", "lag(longitude) OVER w", "latitude", "longitude")}, 0.0::DOUBLE) AS step_km, row_number() OVER w = 1 AS begins,
        elevation_m - last_value(elevation_m IGNORE NULLS) OVER (PARTITION BY trip_id, file_number, segment_index ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up,
        {hav("lag(latitude) OVER t", "lag(longitude) OVER t", "latitude", "longitude")} AS gap FROM cp WINDOW w AS (PARTITION BY trip_id, file_number, segment_index ORDER BY seq), t AS (PARTITION BY trip_id ORDER BY file_number, segment_index, seq)
), sd AS (SELECT *, sum(step_km) OVER (PARTITION BY trip_id, file_number, segment_index ORDER BY seq) AS km FROM sg), sk AS (SELECT *, CASE WHEN elevation_m IS NOT NULL THEN km END AS kd FROM sd),
se AS (
    SELECT *, first_value(kd IGNORE NULLS) OVER w AS da, last_value(kd IGNORE NULLS) OVER w AS db, first_value(elevation_m IGNORE NULLS) OVER w AS ea, last_value(elevation_m IGNORE NULLS) OVER w AS eb FROM sk
    WINDOW w AS (PARTITION BY trip_id, file_number, segment_index ORDER BY km RANGE BETWEEN 0.25::DOUBLE PRECEDING AND 0.25::DOUBLE FOLLOWING)
), ss AS (SELECT *, CASE WHEN db - da >= 0.05 THEN greatest(-20.0::DOUBLE, least(20.0::DOUBLE, (eb - ea) / ((db - da) * 1000) * 100)) ELSE 0.0 END AS slope FROM se),
sm AS (SELECT *, (slope + coalesce(lag(slope) OVER (PARTITION BY trip_id, file_number, segment_index ORDER BY seq), slope)) / 2 AS mean FROM ss),
jp AS (
    SELECT trip_id, file_number, segment_index, seq, elevation_m, slope, sum(step_km) OVER t AS distance_km, sum(greatest(coalesce(up, 0.0), 0.0)) OVER t AS gain_m, sum(greatest(-coalesce(up, 0.0), 0.0)) OVER t AS loss_m,
        sum(step_km / ({MULTIPLIER.format("mean")})) OVER t AS weighted_km, CASE WHEN begins THEN gap END AS gap_km FROM sm WINDOW t AS (PARTITION BY trip_id ORDER BY file_number, segment_index, seq)
)"""

SQL = {
    "joined_profiles": f"""WITH {JOINED_SQL} SELECT trip_id, file_number, segment_index, seq, {", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ("slope", "distance_km", "gain_m", "loss_m", "weighted_km", "gap_km"))} FROM jp""",
    "joined_summaries": f"""WITH {JOINED_SQL}, a AS (
            SELECT trip_id, count(DISTINCT file_number) AS files, count(DISTINCT (file_number, segment_index)) AS segments, count(*) AS points, max(distance_km) AS distance_km, max(gain_m) AS gain_m, max(loss_m) AS loss_m,
                max(weighted_km) AS weighted_km, min(elevation_m) AS min_m, max(elevation_m) AS max_m, coalesce(max(gap_km), 0) AS largest_gap_km, min(file_number) AS first_file, max(file_number) AS last_file FROM jp GROUP BY 1
        ) SELECT trip_id, files, segments, points, {", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ("distance_km", "gain_m", "loss_m", "weighted_km", "min_m", "max_m", "largest_gap_km"))}, first_file, last_file,
            last_file - first_file + 1 = files AND largest_gap_km <= 3.2 AS continuous FROM a""",
    "canonical_waypoints": f"""WITH RECURSIVE {PARTS_SQL}, {located("w0", "wl")}
        SELECT * REPLACE (round(km, 6) + 0.0 AS km, round(latitude, 6) + 0.0 AS latitude, round(longitude, 6) + 0.0 AS longitude, round(elevation_m, 6) + 0.0 AS elevation_m, CAST(climb_id AS VARCHAR) AS climb_id) FROM wl""",
    "stage_itineraries": f"""WITH RECURSIVE {ITINERARY_SQL}
        SELECT route_id, position, waypoint_id, kind, importance, name, round(km, 6) + 0.0 AS km, round(elevation_m, 6) + 0.0 AS elevation_m, CAST(climb_id AS VARCHAR) AS climb_id, pm AS pause_minutes, round(moving, 6) + 0.0 AS moving_minutes, round(elapsed, 6) + 0.0 AS elapsed_minutes,
            lpad(CAST(tm % 1440 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(tm % 60 AS VARCHAR), 2, '0') || CASE WHEN tm >= 1440 THEN ' (+' || (tm // 1440) || ' j)' ELSE '' END AS clock_time,
            pm IS NOT NULL OR kind IN ('start', 'end', 'mountain-pass', 'saddle', 'pause') OR (kind = 'climb' AND importance = 'major') AS visible FROM ct""",
    "built_stages": """
        WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem),
        p AS (SELECT k, string_agg(CAST(k * 10 + n AS VARCHAR), ',' ORDER BY n DESC) FILTER (n % 2 = 1) AS ps, string_agg(CAST(k * 10 + n AS VARCHAR), ',' ORDER BY n DESC) FILTER (n % 2 = 0) AS cs FROM l GROUP BY k),
        o AS (SELECT *, o_custkey AS c, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS i FROM orders)
        SELECT c AS trip_id, 'stage-' || o.k AS stage_id, 'day-' || o.k AS day_id, i AS index, i + 1 AS display_number, CASE WHEN c % 3 <> 0 THEN strftime(DATE '2024-02-20' + CAST(c % 20 AS INT) + i, '%Y-%m-%d') END AS date,
            CASE WHEN o.k % 4 <> 0 THEN 'Etape ' || o.k END AS name, 'Départ étape ' || (i + 1) AS start_name, 'Arrivée étape ' || (i + 1) AS end_name, CASE WHEN o.k % 5 <> 0 THEN o.k % 30000 + 600 + o.k % 90 * 60 END AS total_s,
            CASE WHEN o.k % 7 = 0 THEN 'needs-review' ELSE 'valid' END AS validation, coalesce(ps, '') AS point_ids, coalesce(cs, '') AS climb_ids FROM o JOIN customer ON c_custkey = c LEFT JOIN p ON p.k = o.k""",
    "assembled_trips": """
        WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem),
        p AS (SELECT k, count(*) FILTER (n % 2 = 1) AS np, count(*) FILTER (n % 2 = 0) AS nc, string_agg('climb-' || (k * 10 + n), ',' ORDER BY n DESC) FILTER (n % 2 = 0) AS cs FROM l GROUP BY k),
        t AS (
            SELECT o_custkey AS c, CAST(count(*) AS INT) AS d, CAST(sum(coalesce(nc, 0)) AS INT) AS nc, CAST(sum(coalesce(np, 0)) AS INT) AS np, CAST(sum(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 90 * 60 ELSE 0 END) AS BIGINT) AS b,
                last('route-' || o_orderkey ORDER BY o_orderdate, o_orderkey) AS r, last(coalesce(cs, '') ORDER BY o_orderdate, o_orderkey) AS cs FROM orders LEFT JOIN p ON k = o_orderkey GROUP BY 1
        )
        SELECT c_custkey AS trip_id, CASE WHEN c_custkey % 3 <> 0 THEN 'ready' ELSE 'draft' END AS status, CASE WHEN c_custkey % 3 <> 0 THEN strftime(DATE '2024-02-20' + CAST(c_custkey % 20 AS INT), '%Y-%m-%d') END AS start_date,
            CASE WHEN c_custkey % 3 <> 0 AND d IS NOT NULL THEN strftime(DATE '2024-02-20' + CAST(c_custkey % 20 AS INT) + d - 1, '%Y-%m-%d') END AS end_date, CASE WHEN c_custkey % 3 <> 0 THEN 'Europe/Paris' END AS timezone,
            c_custkey % 9 + 14.0::DOUBLE AS reference_kph, coalesce(d, 0) AS n_days, coalesce(d, 0) AS n_stages, coalesce(d, 0) AS n_routes, coalesce(nc, 0) AS n_climbs, coalesce(np, 0) AS "n_routePoints", 0 AS n_weather, coalesce(b, 0) AS break_s,
            r AS last_route, cs AS last_climbs FROM customer LEFT JOIN t ON c = c_custkey""",
}
