"""SQL (DuckDB) for the registered queries, written from the definitions and not from the DataFrame code."""

from __future__ import annotations

from trailframe.plans.carriers import HOURLY_SQL, POINTS_SQL, STEPS_SQL, STOPS_SQL, hav

PI = "3.141592653589793::DOUBLE"


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


FACTOR = """CASE WHEN g <= -15 THEN 2.2 WHEN g <= -8 THEN 2.2 + (1.8 - 2.2) * ((g + 15) / 7.0) WHEN g <= -4 THEN 1.8 + (1.35 - 1.8) * ((g + 8) / 4.0)
    WHEN g <= 0 THEN 1.35 + (1.0 - 1.35) * ((g + 4) / 4.0) WHEN g <= 3 THEN 1.0 + (0.78 - 1.0) * (g / 3.0) WHEN g <= 6 THEN 0.78 + (0.56 - 0.78) * ((g - 3) / 3.0)
    WHEN g <= 9 THEN 0.56 + (0.42 - 0.56) * ((g - 6) / 3.0) ELSE 0.42 + (0.32 - 0.42) * ((g - 9) / 6.0) END"""
MULTIPLIER = "CASE WHEN {0} <= -8 THEN 1.45::DOUBLE WHEN {0} <= -3 THEN 1.2 WHEN {0} <= 3 THEN 1.0 WHEN {0} <= 6 THEN 0.78 WHEN {0} <= 9 THEN 0.58 ELSE 0.42 END"
BAND = "CASE WHEN {0} <= -8 THEN 0 WHEN {0} <= -3 THEN 1 WHEN {0} <= 3 THEN 2 WHEN {0} <= 6 THEN 3 WHEN {0} <= 9 THEN 4 ELSE 5 END"
CLASS = """CASE WHEN {0} < -7 THEN 'descent-7-plus' WHEN {0} < 0 THEN 'descent-0-7' WHEN {0} < 1 THEN 'climb-0-1' WHEN {0} < 4 THEN 'climb-1-4' WHEN {0} < 8 THEN 'climb-4-8'
    WHEN {0} < 12 THEN 'climb-8-12' WHEN {0} IS NOT NULL THEN 'climb-12-plus' END"""

METRICS = """count(*) AS points, round(sum(step_km), 6) AS distance_km, round(sum(CASE WHEN up > 0 THEN up WHEN up IS NOT NULL THEN 0.0 END), 6) AS gain_m,
    round(sum(CASE WHEN up < 0 THEN -up WHEN up IS NOT NULL THEN 0.0 END), 6) + 0.0 AS loss_m, round(min(elevation_m), 6) AS min_m, round(max(elevation_m), 6) AS max_m"""

SMOOTH_SQL = f"""{STEPS_SQL}, smoothed AS (
    SELECT *, avg(elevation_m) OVER (PARTITION BY route_id ORDER BY distance_km RANGE BETWEEN 0.075::DOUBLE PRECEDING AND 0.075::DOUBLE FOLLOWING) AS smoothed_m FROM series)"""


def grid_sql(source: str, value: str, step: float, to: str) -> str:
    """CTEs: a grid over `source` and the linear value at each target, with the other side's value where one is missing."""
    return f"""{to}_grid AS (
        SELECT route_id, CAST(unnest(range(0, CAST(ceil(total / {step}::DOUBLE - 1e-9) AS INT) + 1)) AS INT) AS k, total FROM
        (SELECT route_id, max(distance_km) AS total FROM {source} GROUP BY 1) WHERE total > 1e-9
    ), {to}_ask AS (SELECT route_id, k, least(k * {step}::DOUBLE, total) AS t FROM {to}_grid),
    {to}_pair AS (
        SELECT a.route_id, a.k, a.t, (SELECT max(s.distance_km) FROM {source} s WHERE s.route_id = a.route_id AND s.distance_km < a.t) AS d0,
            (SELECT min(s.distance_km) FROM {source} s WHERE s.route_id = a.route_id AND s.distance_km >= a.t) AS d1 FROM {to}_ask a
    ), {to} AS (
        SELECT p.route_id, p.k, p.t AS distance_km, coalesce(x.{value}, y.{value}) + (coalesce(y.{value}, x.{value}) - coalesce(x.{value}, y.{value}))
            * CASE WHEN y.distance_km - x.distance_km <= 1e-9 THEN 0.0 ELSE greatest(0.0, least(1.0, (p.t - x.distance_km) / (y.distance_km - x.distance_km))) END AS {value}
        FROM {to}_pair p JOIN {source} x ON x.route_id = p.route_id AND x.distance_km = coalesce(p.d0, p.d1)
            JOIN {source} y ON y.route_id = p.route_id AND y.distance_km = coalesce(p.d1, p.d0))"""


def at_sql(source: str, value: str, asked: str, to: str) -> str:
    """CTEs: the linear value of `source` at every t of `asked`."""
    return f"""{to}_pair AS (
        SELECT a.route_id, a.k, a.t, (SELECT max(s.distance_km) FROM {source} s WHERE s.route_id = a.route_id AND s.distance_km < a.t) AS d0,
            (SELECT min(s.distance_km) FROM {source} s WHERE s.route_id = a.route_id AND s.distance_km >= a.t) AS d1 FROM {asked} a
    ), {to} AS (
        SELECT p.route_id, p.k, x.{value} + (y.{value} - x.{value}) * CASE WHEN y.distance_km - x.distance_km <= 1e-9 THEN 0.0
            ELSE greatest(0.0, least(1.0, (p.t - x.distance_km) / (y.distance_km - x.distance_km))) END AS v
        FROM {to}_pair p JOIN {source} x ON x.route_id = p.route_id AND x.distance_km = coalesce(p.d0, p.d1) JOIN {source} y ON y.route_id = p.route_id AND y.distance_km = coalesce(p.d1, p.d0))"""


DISPLAY_SQL = f"""{STEPS_SQL}, {grid_sql("series", "elevation_m", 0.075, "reg0")}, reg AS (SELECT route_id, k, distance_km, coalesce(elevation_m, 0.0) AS e FROM reg0),
    sm AS (SELECT *, avg(e) OVER (PARTITION BY route_id ORDER BY distance_km RANGE BETWEEN 0.075000001::DOUBLE PRECEDING AND 0.075000001::DOUBLE FOLLOWING) AS smoothed_m,
        max(distance_km) OVER (PARTITION BY route_id) AS total FROM reg),
    lk AS (SELECT route_id, k, greatest(0.0, distance_km - 0.25) AS t FROM sm), rk AS (SELECT route_id, k, least(total, distance_km + 0.25) AS t FROM sm),
    {at_sql("sm", "smoothed_m", "lk", "lv")}, {at_sql("sm", "smoothed_m", "rk", "rv")}"""

PROFILE_SQL = f"""{SMOOTH_SQL}, {grid_sql("smoothed", "smoothed_m", 0.05, "grid")}, ends AS (
    SELECT *, first_value(distance_km) OVER w AS da, last_value(distance_km) OVER w AS db, first_value(smoothed_m) OVER w AS ea, last_value(smoothed_m) OVER w AS eb FROM grid
    WINDOW w AS (PARTITION BY route_id ORDER BY distance_km RANGE BETWEEN 0.100000001::DOUBLE PRECEDING AND 0.100000001::DOUBLE FOLLOWING)
), profile AS (
    SELECT route_id, k, distance_km, smoothed_m, CASE WHEN db - da >= 0.02 THEN greatest(-20.0::DOUBLE, least(20.0::DOUBLE, (eb - ea) / ((db - da) * 1000) * 100)) ELSE 0.0 END AS grade FROM ends)"""
TIMED_SQL = f"""{PROFILE_SQL}, f AS (
    SELECT *, {FACTOR.replace("g <=", "greatest(-15.0::DOUBLE, least(15.0::DOUBLE, coalesce(grade, 0.0))) <=").replace("(g ", "(greatest(-15.0::DOUBLE, least(15.0::DOUBLE, coalesce(grade, 0.0))) ")} AS factor FROM profile
), m AS (
    SELECT *, coalesce(greatest(0.0, distance_km - lag(distance_km) OVER w) / greatest(3.0, least(55.0, 18.0 * greatest(0.1, (lag(factor) OVER w + factor) / 2))) * 60, 0.0) AS step FROM f
    WINDOW w AS (PARTITION BY route_id ORDER BY k)
), timed AS (SELECT *, sum(step) OVER (PARTITION BY route_id ORDER BY k) AS moving_minutes, greatest(3.0, least(55.0, 18.0 * factor)) AS local_kph FROM m)"""
SLOPES_SQL = f"""{STEPS_SQL}, known AS (
    SELECT *, CASE WHEN elevation_m IS NOT NULL THEN distance_km END AS kd FROM series
), slopes AS (
    SELECT *, CASE WHEN db - da >= 0.05 THEN greatest(-20.0::DOUBLE, least(20.0::DOUBLE, (eb - ea) / ((db - da) * 1000) * 100)) ELSE 0.0 END AS slope FROM (
        SELECT *, first_value(kd IGNORE NULLS) OVER w AS da, last_value(kd IGNORE NULLS) OVER w AS db, first_value(elevation_m IGNORE NULLS) OVER w AS ea,
            last_value(elevation_m IGNORE NULLS) OVER w AS eb FROM known
        WINDOW w AS (PARTITION BY route_id ORDER BY distance_km RANGE BETWEEN 0.25::DOUBLE PRECEDING AND 0.25::DOUBLE FOLLOWING)))"""

VALUES = "apparent_c, precipitation_mm, precipitation_pct, snowfall_cm, weather_code, wind_kph, gust_kph, visibility_m, freezing_m"
NEAR_SQL = f"""{HOURLY_SQL}, {STOPS_SQL}, near AS (
    SELECT s.*, h.time AS forecast_time, h.minutes_off, {", ".join("h." + v for v in VALUES.split(", "))} FROM stops s LEFT JOIN (
        SELECT s.point_id, h.*, abs(epoch(h.time) - epoch(s.eta)) / 60.0 AS minutes_off,
            row_number() OVER (PARTITION BY s.point_id ORDER BY abs(epoch(h.time) - epoch(s.eta)), h.time) AS n
        FROM stops s JOIN hourly h ON s.location_id = h.location_id AND abs(epoch(h.time) - epoch(s.eta)) <= 3600
    ) h ON h.point_id = s.point_id AND h.n = 1)"""


def findings_sql(source: str) -> str:
    """CTEs: the nine hazards' levels, then one row a finding in the fixed order."""
    return f"""lv AS (
        SELECT *, CASE WHEN precipitation_mm >= 4 OR (precipitation_pct >= 80 AND precipitation_mm >= 2) THEN 'red'
                WHEN precipitation_mm >= 1.5 OR (precipitation_pct >= 60 AND precipitation_mm >= 0.5) THEN 'orange' END AS l0,
            CASE WHEN weather_code IN (96, 99) THEN 'red' WHEN weather_code = 95 THEN 'orange' END AS l1,
            CASE WHEN apparent_c <= CASE WHEN exposed THEN 0 ELSE -2 END THEN 'red' WHEN apparent_c <= CASE WHEN exposed THEN 5 ELSE 3 END THEN 'orange' END AS l3,
            CASE WHEN apparent_c >= 35 THEN 'red' WHEN apparent_c >= 30 THEN 'orange' END AS l4,
            CASE WHEN wind_kph >= 50 THEN 'red' WHEN wind_kph >= 35 THEN 'orange' END AS l5,
            CASE WHEN gust_kph >= CASE WHEN exposed THEN 65 ELSE 70 END THEN 'red' WHEN gust_kph >= CASE WHEN exposed THEN 45 ELSE 50 END THEN 'orange' END AS l6,
            CASE WHEN visibility_m < 1000 THEN 'red' WHEN visibility_m < 5000 THEN 'orange' END AS l7
        FROM (SELECT *, kind IN ('col', 'summit') OR elevation_m >= 1500 OR strategic AS exposed FROM {source})
    ), lx AS (
        SELECT *, CASE WHEN snowfall_cm > 0 THEN CASE WHEN snowfall_cm >= 1 OR (exposed AND (l5 IS NOT NULL OR l6 IS NOT NULL) AND l3 IS NOT NULL) THEN 'red' ELSE 'orange' END END AS l2,
            CASE WHEN freezing_m - elevation_m <= 300 THEN CASE WHEN freezing_m - elevation_m <= 0 OR (exposed AND l0 IS NOT NULL AND l3 IS NOT NULL) THEN 'red' ELSE 'orange' END END AS l8
        FROM lv
    ), fx AS (
        SELECT * FROM (
            SELECT *, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS rank, unnest(['precipitation', 'thunderstorm', 'snow', 'cold', 'heat', 'wind', 'gust', 'visibility', 'freezing-level']) AS risk,
                unnest([l0, l1, l2, l3, l4, l5, l6, l7, l8]) AS level,
                unnest([precipitation_mm, NULL, snowfall_cm, apparent_c, apparent_c, wind_kph, gust_kph, visibility_m, freezing_m]) AS value FROM lx
        ) WHERE level IS NOT NULL)"""


ALERTS_SQL = f"""{NEAR_SQL}, tm AS (SELECT *, eta >= TIMESTAMP '2024-01-15 12:00:00' AS upcoming FROM near), {findings_sql("tm")}, al AS (
    SELECT *, row_number() OVER (PARTITION BY day_id ORDER BY eta, point_id, rank) AS ord FROM fx
), groups AS (
    SELECT day_id, island, min(risk) AS risk, min(level) AS level, count(*) AS alerts, count(DISTINCT point_id) AS points, arg_min(point_id, ord) AS first_point,
        arg_max(point_id, ord) AS last_point, min(eta) AS first_eta, max(eta) AS last_eta, max(value) AS value, bool_or(upcoming) AS upcoming
    FROM (SELECT *, sum(CASE WHEN risk = pr AND level = pl THEN 0 ELSE 1 END) OVER (PARTITION BY day_id ORDER BY ord) AS island FROM (
        SELECT *, lag(risk) OVER w AS pr, lag(level) OVER w AS pl FROM al WINDOW w AS (PARTITION BY day_id ORDER BY ord)))
    GROUP BY day_id, island)"""

SCENARIO_SQL = f"""{HOURLY_SQL}, {STOPS_SQL}, sh AS (
    SELECT * EXCLUDE (eta), eta + to_minutes(o) AS eta, o AS "offset" FROM stops CROSS JOIN (SELECT unnest([-120, -60, 0, 60, 120]) AS o)
), sn AS (
    SELECT s.*, h.time AS forecast_time, {", ".join("h." + v for v in VALUES.split(", "))} FROM sh s LEFT JOIN (
        SELECT s.point_id, s."offset" AS o, h.*, row_number() OVER (PARTITION BY s.point_id, s."offset" ORDER BY abs(epoch(h.time) - epoch(s.eta)), h.time) AS n
        FROM sh s JOIN hourly h ON s.location_id = h.location_id AND abs(epoch(h.time) - epoch(s.eta)) <= 3600
    ) h ON h.point_id = s.point_id AND h.o = s."offset" AND h.n = 1
), {findings_sql("sn")}, counted AS (
    SELECT day_id, "offset", count(*) FILTER (level = 'red') AS red, count(*) FILTER (level = 'orange') AS orange FROM fx GROUP BY 1, 2
), sm AS (
    SELECT day_id, "offset", CAST(coalesce(any_value(c.red), 0) AS BIGINT) AS red, CAST(coalesce(any_value(c.orange), 0) AS BIGINT) AS orange, count(forecast_time) AS covered,
        max(precipitation_mm) AS rain_mm, max(gust_kph) AS gust_kph, min(apparent_c) AS apparent_c, min(apparent_c) FILTER (exposed) AS exposed_c, min(visibility_m) AS visibility_m,
        min(eta >= date) AS coherent,
        count(forecast_time) FILTER (kind <> 'poi') / nullif(count(*) FILTER (kind <> 'poi'), 0) AS coverage FROM lx LEFT JOIN counted c USING (day_id, "offset") GROUP BY 1, 2
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY day_id ORDER BY coherent DESC, red, orange, covered DESC, rain_mm ASC NULLS LAST, gust_kph ASC NULLS LAST, apparent_c DESC NULLS FIRST,
        visibility_m DESC NULLS FIRST, abs("offset"), "offset") AS rank FROM sm)"""

SUMMARY = """count(*) AS hours, (max(CASE WHEN weather_code IS NOT NULL THEN {'s': CASE weather_code WHEN 0 THEN 0 WHEN 3 THEN 3 WHEN 45 THEN 5 WHEN 61 THEN 5 WHEN 65 THEN 8 WHEN 80 THEN 6
    WHEN 95 THEN 10 WHEN 96 THEN 11 ELSE -1 END, 'c': weather_code} END)).c AS worst_code, min(apparent_c) AS min_apparent_c, max(apparent_c) AS max_apparent_c, min(wind_kph) AS min_wind_kph,
    max(wind_kph) AS max_wind_kph, min(gust_kph) AS min_gust_kph, max(gust_kph) AS max_gust_kph, min(precipitation_mm) AS min_precipitation_mm, max(precipitation_mm) AS max_precipitation_mm,
    min(visibility_m) AS min_visibility_m, max(visibility_m) AS max_visibility_m, count(gust_kph) AS with_gust"""

PLACES_SQL = """places AS (
    SELECT c_custkey AS place_id, 45.0::DOUBLE + (c_custkey % 150) * 0.01::DOUBLE + (c_custkey % 50) * 0.0003::DOUBLE + (c_custkey % 7) * 1e-4::DOUBLE AS latitude,
        6.0::DOUBLE + (c_custkey % 50) * 0.0003::DOUBLE AS longitude, CASE WHEN c_custkey % 6 <> 0 THEN 'p' || CAST(c_custkey % 9 AS VARCHAR) END AS name, c_mktsegment AS category,
        'layer' || CAST(c_custkey % 4 AS VARCHAR) AS layer FROM customer)"""
SEGMENT_SQL = f"""{POINTS_SQL}, {PLACES_SQL}, segs AS (
    SELECT route_id, seq AS segment, latitude AS lat1, longitude AS lon1, lead(latitude) OVER w AS lat2, lead(longitude) OVER w AS lon2 FROM track_points
    WINDOW w AS (PARTITION BY route_id ORDER BY seq)
), flat AS (
    SELECT place_id, route_id, segment, (lon2 - lon1) * xs AS ex, (lat2 - lat1) * ys AS ey, (longitude - lon1) * xs AS px, (latitude - lat1) * ys AS py FROM (
        SELECT *, cos(radians((lat1 + lat2 + latitude) / 3)) * (6371000.0::DOUBLE * {PI} / 180) AS xs, 6371000.0::DOUBLE * {PI} / 180 AS ys
        FROM places p JOIN segs s ON s.lat2 IS NOT NULL AND abs(p.latitude - s.lat1) < 0.03)
), proj AS (
    SELECT *, sqrt(pow(px - ratio * ex, 2) + pow(py - ratio * ey, 2)) AS lateral_m FROM (
        SELECT *, CASE WHEN ex * ex + ey * ey = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (px * ex + py * ey) / (ex * ex + ey * ey))) END AS ratio FROM flat)
), nearest AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place_id, route_id ORDER BY lateral_m, segment) AS n FROM proj WHERE lateral_m <= 250) WHERE n = 1)"""

DAYS_SQL = """days AS (
    SELECT *, CASE WHEN kind = 'ride' AND p <> '5-LOW' THEN q END AS distance_km, CASE WHEN kind = 'ride' THEN t END AS gain_m, CASE WHEN kind = 'ride' AND p <> '1-URGENT' THEN 'd' || p END AS departure,
        CASE WHEN kind = 'ride' AND p <> '2-HIGH' THEN 'a' || p END AS arrival, CASE WHEN kind <> 'ride' AND p = '3-MEDIUM' THEN 'by hand' END AS manual,
        kind = 'transfer' AND day_id % 4 = 1 AS attached FROM (
        SELECT o_custkey AS trip_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS position, o_orderkey AS day_id,
            CASE WHEN o_orderstatus <> 'P' THEN 'ride' WHEN o_orderkey % 2 = 0 THEN 'off' ELSE 'transfer' END AS kind, o_orderpriority AS p, l.q, l.t, CAST(o_orderdate AS DATE) AS order_date
        FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_quantity), 2) AS q, round(sum(l_tax) * 1000, 2) AS t FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey)
), dated AS (
    SELECT *, CAST(row_number() OVER w - 1 AS INT) AS "index", CAST(sum(CASE WHEN attached THEN 0 ELSE 1 END) OVER w AS BIGINT) AS display_number,
        CAST(DATE '2024-06-01' + CAST(row_number() OVER w - 1 AS INT) AS DATE) AS date FROM days WINDOW w AS (PARTITION BY trip_id ORDER BY position))"""

SQL = {
    "name_keys": """WITH n AS (SELECT doc_id, lower(strip_accents(text)) AS s FROM documents)
        SELECT doc_id, nullif(regexp_replace(s, '[^a-z0-9]+', '', 'g'), '') AS key, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) AS words FROM n""",
    "climb_landmarks": """WITH o AS (SELECT o_orderkey AS id, o_custkey % 100 AS route_id, round(o_totalprice % 200, 2) AS km, o_orderpriority AS p FROM orders),
        j AS (SELECT c.route_id, c.id AS climb_id, m.id AS landmark_id, m.p AS name, row_number() OVER (PARTITION BY c.route_id, c.id ORDER BY CASE WHEN m.p = '1-URGENT' THEN 0 ELSE 1 END, abs(m.km - c.km), m.id) AS n
            FROM o c JOIN o m ON c.route_id = m.route_id AND c.id % 3 = 0 AND m.id % 3 <> 0 AND m.p <> '5-LOW' AND abs(m.km - c.km) <= 1)
        SELECT route_id, climb_id, landmark_id, name FROM j WHERE n = 1""",
    "track_metrics": f"WITH {STEPS_SQL} SELECT route_id, {METRICS}, count(elevation_m) AS with_altitude, round(count(elevation_m) / count(*), 6) AS coverage, count(elevation_m) / count(*) >= 0.5 AND count(elevation_m) >= 2 AS sufficient FROM series GROUP BY 1",
    "track_summary_by_segment": f"""WITH {POINTS_SQL}, st AS (SELECT *, coalesce({hav("lag(latitude) OVER w", "lag(longitude) OVER w", "latitude", "longitude")}, 0.0::DOUBLE) AS step_km,
        elevation_m - last_value(elevation_m IGNORE NULLS) OVER (PARTITION BY route_id, segment_index ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up
        FROM track_points WINDOW w AS (PARTITION BY route_id, segment_index ORDER BY seq))
        SELECT route_id, count(DISTINCT segment_index) AS segments, {METRICS} FROM st GROUP BY 1""",
    "track_cumulative": f"""WITH {STEPS_SQL}, fl AS (SELECT *, coalesce(sqrt(pow(radians(longitude - lag(longitude) OVER w) * cos(radians((latitude + lag(latitude) OVER w) / 2)), 2)
        + pow(radians(latitude - lag(latitude) OVER w), 2)) * 6371000.0::DOUBLE, 0.0) AS fm FROM series WINDOW w AS (PARTITION BY route_id ORDER BY seq))
        SELECT route_id, seq, round(distance_km, 5) AS distance_km, round(sum(fm) OVER (PARTITION BY route_id ORDER BY seq), 5) AS distance_m FROM fl""",
    "track_segment_gaps": f"""WITH {STEPS_SQL} SELECT route_id, segment_index, round(step_km, 6) AS gap_km FROM series WHERE seq > 0 AND seq % 40 = 0 AND step_km > 0.035""",
    "track_backward_time": f"""WITH {POINTS_SQL}, late AS (SELECT route_id, seq, CASE WHEN seq % 7 <> 3 THEN ts - to_minutes(CAST((seq % 11) * 200 AS INT)) END AS t FROM track_points),
        k AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM late)
        SELECT route_id, min(seq) AS seq FROM k WHERE t < b GROUP BY 1""",
    "track_bounds": f"WITH {POINTS_SQL} SELECT route_id, {r('min(latitude)', 'south')}, {r('min(longitude)', 'west')}, {r('max(latitude)', 'north')}, {r('max(longitude)', 'east')} FROM track_points GROUP BY 1",
    "track_valid_coordinates": f"""WITH {POINTS_SQL}, b AS (SELECT route_id, coalesce(abs(CASE WHEN seq % 13 <> 5 THEN latitude * CASE WHEN seq % 17 = 4 THEN 2.5 ELSE 1 END END) <= 90, false) AS ok FROM track_points)
        SELECT route_id, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS dropped FROM b GROUP BY 1""",
    "track_continuity": f"""WITH {POINTS_SQL}, e AS (SELECT chain, route_id, arg_min(latitude, seq) AS a1, arg_min(longitude, seq) AS a2, arg_max(latitude, seq) AS b1, arg_max(longitude, seq) AS b2 FROM track_points GROUP BY 1, 2),
        l AS (SELECT *, lag(route_id) OVER w AS from_id, lag(b1) OVER w AS p1, lag(b2) OVER w AS p2 FROM e WINDOW w AS (PARTITION BY chain ORDER BY route_id))
        SELECT chain, from_id, route_id AS to_id, round({hav("p1", "p2", "a1", "a2")}, 6) AS gap_km, {hav("p1", "p2", "a1", "a2")} > 1 AS warning FROM l WHERE from_id IS NOT NULL""",
    "track_even_sample": f"""WITH {POINTS_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY route_id) AS c FROM track_points)
        SELECT route_id, seq, {r("latitude", "latitude")}, {r("longitude", "longitude")} FROM n WHERE c <= 5 OR seq IN (0, floor((c - 1) / 4.0 + 0.5), floor(2 * (c - 1) / 4.0 + 0.5), floor(3 * (c - 1) / 4.0 + 0.5), c - 1)""",
    "track_chunks": f"""WITH RECURSIVE {POINTS_SQL}, fl AS (SELECT *, coalesce(sqrt(pow(radians(longitude - lag(longitude) OVER w) * cos(radians((latitude + lag(latitude) OVER w) / 2)), 2)
        + pow(radians(latitude - lag(latitude) OVER w), 2)) * 6371000.0::DOUBLE, 0.0) AS fm FROM track_points WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
        d AS (SELECT route_id, seq, sum(fm) OVER (PARTITION BY route_id ORDER BY seq) AS m FROM fl),
        c AS (SELECT route_id, seq, 0 AS chunk, CASE WHEN m >= 700 THEN 1 ELSE 0 END AS nxt, CASE WHEN m >= 700 THEN m ELSE 0.0::DOUBLE END AS base FROM d WHERE seq = 0
            UNION ALL SELECT d.route_id, d.seq, c.nxt, CASE WHEN d.m - c.base >= 700 THEN c.nxt + 1 ELSE c.nxt END, CASE WHEN d.m - c.base >= 700 THEN d.m ELSE c.base END
            FROM c JOIN d ON d.route_id = c.route_id AND d.seq = c.seq + 1)
        SELECT route_id, chunk, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS points FROM c GROUP BY 1, 2""",
    "track_local_slopes": f"WITH {SLOPES_SQL} SELECT route_id, seq, {r('slope', 'slope', 4)}, {MULTIPLIER.format('slope')} AS multiplier FROM slopes",
    "track_slope_changes": f"""WITH {SLOPES_SQL}, b AS (SELECT *, lag(slope) OVER w AS s, lag({BAND.format("slope")}) OVER w AS pb FROM slopes WINDOW w AS (PARTITION BY route_id ORDER BY seq))
        SELECT route_id, count(*) AS changes, min(seq) AS first_seq FROM b WHERE abs(slope - s) >= 5 AND abs({BAND.format("slope")} - pb) >= 2 GROUP BY 1""",
    "weighted_distance": f"""WITH {SLOPES_SQL}, b AS (SELECT *, (slope + coalesce(lag(slope) OVER (PARTITION BY route_id ORDER BY seq), slope)) / 2 AS m FROM slopes)
        SELECT route_id, round(sum(step_km / {MULTIPLIER.format("m")}), 4) AS weighted_km, round(max(distance_km), 4) AS distance_km FROM b GROUP BY 1""",
    "terrain_smoothed": f"WITH {SMOOTH_SQL} SELECT route_id, seq, round(smoothed_m, 4) AS smoothed_m FROM smoothed",
    "terrain_slope_profile": f"WITH {PROFILE_SQL} SELECT route_id, k, round(distance_km, 3) AS distance_km, round(smoothed_m, 3) AS smoothed_m, {r('grade', 'grade', 3)} FROM profile",
    "terrain_display_profile": f"""WITH {DISPLAY_SQL} SELECT sm.route_id, sm.k, round(sm.distance_km, 3) AS distance_km, round(smoothed_m, 3) AS smoothed_m,
        {r("CASE WHEN rk.t - lk.t <= 1e-9 THEN 0.0 ELSE greatest(-20.0::DOUBLE, least(20.0::DOUBLE, (rv.v - lv.v) / ((rk.t - lk.t) * 1000) * 100)) END", "grade", 3)}
        FROM sm JOIN lk USING (route_id, k) JOIN rk USING (route_id, k) JOIN lv USING (route_id, k) JOIN rv USING (route_id, k)""",
    "similar_tracks": f"""WITH {STEPS_SQL}, b AS (SELECT route_id, seq, latitude - floor(route_id / 3) * 0.01::DOUBLE * 2 + floor(route_id / 3) % 2 * 0.02::DOUBLE AS la, longitude AS lo, count(*) OVER (PARTITION BY route_id) AS c FROM series),
        p AS (SELECT route_id, la, lo, seq FROM b WHERE c <= 5 OR seq IN (0, floor((c - 1) / 4.0 + 0.5), floor(2 * (c - 1) / 4.0 + 0.5), floor(3 * (c - 1) / 4.0 + 0.5), c - 1)),
        t AS (SELECT route_id, max(distance_km) AS d FROM series GROUP BY 1),
        e AS (SELECT route_id, d, arg_min(la, seq) AS a1, arg_min(lo, seq) AS a2, arg_max(la, seq) AS b1, arg_max(lo, seq) AS b2 FROM p JOIN t USING (route_id) GROUP BY 1, 2),
        q AS (SELECT x.route_id AS a, y.route_id AS b, {hav("x.a1", "x.a2", "y.a1", "y.a2")} AS start_km, {hav("x.b1", "x.b2", "y.b1", "y.b2")} AS end_km, abs(x.d - y.d) / greatest(x.d, y.d) AS length_share
            FROM e x JOIN e y ON x.route_id < y.route_id),
        z AS (SELECT *, (SELECT count(*) FROM p u WHERE u.route_id = q.a AND EXISTS (SELECT 1 FROM p v WHERE v.route_id = q.b AND {hav("u.la", "u.lo", "v.la", "v.lo")} <= 0.5)) AS m1, (SELECT count(*) FROM p u WHERE u.route_id = q.a) AS n1,
            (SELECT count(*) FROM p u WHERE u.route_id = q.b AND EXISTS (SELECT 1 FROM p v WHERE v.route_id = q.a AND {hav("u.la", "u.lo", "v.la", "v.lo")} <= 0.5)) AS m2, (SELECT count(*) FROM p u WHERE u.route_id = q.b) AS n2
            FROM q WHERE start_km <= 0.5 AND end_km <= 0.5 AND length_share <= 0.3)
        SELECT a, b, round(start_km, 4) AS start_km, round(end_km, 4) AS end_km, round(length_share, 4) AS length_share, round(least(m1 / n1, m2 / n2), 4) AS match FROM z WHERE least(m1 / n1, m2 / n2) >= 0.8""",
    "terrain_timing": f"WITH {TIMED_SQL} SELECT route_id, round(max(moving_minutes), 3) AS minutes, round(min(local_kph), 3) AS slowest, round(max(local_kph), 3) AS fastest FROM timed GROUP BY 1",
    "terrain_pauses": f"""WITH {TIMED_SQL}, tt AS (SELECT *, max(distance_km) OVER (PARTITION BY route_id) AS total FROM timed), pz AS (
        SELECT route_id, k, moving_minutes, CASE WHEN total * 0.25::DOUBLE < distance_km - 1e-9 THEN 15.0 ELSE 0.0 END + CASE WHEN total * 0.5::DOUBLE < distance_km - 1e-9 THEN 30.0 ELSE 0.0 END
            + CASE WHEN total * 0.75::DOUBLE < distance_km - 1e-9 THEN 15.0 ELSE 0.0 END AS paused_minutes FROM tt
        ), cl AS (SELECT *, CAST(floor(1430 + moving_minutes + paused_minutes + 0.5) AS BIGINT) AS a FROM pz)
        SELECT route_id, k, CAST(paused_minutes AS DOUBLE) AS paused_minutes, CAST(a % 1440 AS INT) AS clock_minutes, CAST(a // 1440 AS INT) AS day_offset,
            lpad(CAST((a % 1440) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a % 60 AS VARCHAR), 2, '0') || CASE WHEN a >= 1440 THEN ' (+' || CAST(a // 1440 AS VARCHAR) || ' j)' ELSE '' END AS text FROM cl""",
    "terrain_extrema": f"""WITH {PROFILE_SQL}, x AS (SELECT route_id, k, smoothed_m AS e, count(*) OVER b AS nb, count(*) OVER a AS na, min(smoothed_m) OVER b AS lb, max(smoothed_m) OVER b AS hb,
            min(smoothed_m) OVER a AS la, max(smoothed_m) OVER a AS ha FROM profile
            WINDOW b AS (PARTITION BY route_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY route_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
        y AS (SELECT *, CASE WHEN e >= hb AND e > ha AND least(e - lb, e - la) >= 0.3 THEN 'summit' WHEN e <= lb AND e < la AND least(hb - e, ha - e) >= 0.3 THEN 'low' END AS kind FROM x WHERE nb = 3 AND na = 3)
        SELECT route_id, k, kind, round(CASE WHEN kind = 'summit' THEN least(e - lb, e - la) ELSE least(hb - e, ha - e) END, 3) AS prominence_m FROM y WHERE kind IS NOT NULL""",
    "terrain_grade_classes": f"WITH {PROFILE_SQL} SELECT {CLASS.format('round(grade, 4)')} AS grade_class, count(*) AS points FROM profile GROUP BY 1",
    "climb_tiles": f"""WITH {STEPS_SQL}, c AS (SELECT route_id, round(sum(step_km), 6) AS e FROM series GROUP BY 1), t AS (
        SELECT route_id, e, CAST(unnest(range(0, CAST(ceil((e - 0.1 - 1e-9) / 0.5) AS INT))) AS INT) AS tile FROM c WHERE e > 0.1)
        SELECT route_id, 1 AS number, tile, round(0.1 + tile * 0.5, 6)::DOUBLE AS from_km, round(least(e, 0.1 + tile * 0.5 + 0.5), 6)::DOUBLE AS to_km FROM t""",
    "feature_spacing": f"""WITH RECURSIVE {STEPS_SQL}, f AS (SELECT route_id, seq, distance_km, row_number() OVER (PARTITION BY route_id ORDER BY round(elevation_m, 6) DESC, distance_km) AS n FROM series
            WHERE elevation_m IS NOT NULL),
        p AS (SELECT route_id, n, [distance_km] AS kept, true AS take, seq FROM f WHERE n = 1 UNION ALL
            SELECT f.route_id, f.n, CASE WHEN len(list_filter(p.kept, lambda x: abs(x - f.distance_km) < 0.4)) = 0 THEN list_append(p.kept, f.distance_km) ELSE p.kept END,
                len(list_filter(p.kept, lambda x: abs(x - f.distance_km) < 0.4)) = 0, f.seq FROM p JOIN f ON f.route_id = p.route_id AND f.n = p.n + 1)
        SELECT route_id, seq FROM p WHERE take""",
    "speed_rules": f"""WITH q AS (SELECT DISTINCT l_quantity - 25 AS grade FROM lineitem), q2 AS (SELECT *, greatest(-15.0::DOUBLE, least(15.0::DOUBLE, grade)) AS g FROM q), q3 AS (SELECT *, {FACTOR} AS f FROM q2)
        SELECT {r("grade", "grade")}, {r("f", "factor")}, {r("greatest(3.0, least(55.0, 22.0 * f))", "kph")}, {MULTIPLIER.format("grade")} AS multiplier, {CLASS.format("grade")} AS class FROM q3""",
    "break_budget": """WITH q AS (SELECT l_orderkey, sum(l_quantity) AS km, round(sum(l_quantity) * 3.3::DOUBLE, 4) AS mv, CASE WHEN count(*) <> 3 THEN round(sum(l_tax) * 4000, 4) END AS gain FROM lineitem GROUP BY 1),
        h AS (SELECT *, mv / 60 * greatest(3.6, least(16.0, 3.6 + 1.295 * (mv / 60))) * (1 + greatest(0.0, least(60.0, greatest(0.0, coalesce(gain, 0.0)) / km - 5)) / 60 * 0.8) AS raw FROM q)
        SELECT l_orderkey, CASE WHEN km > 0 AND mv > 0 THEN greatest(0.0::DOUBLE, least(240.0::DOUBLE, floor(raw / 5 + 0.5) * 5)) ELSE 0.0 END AS minutes,
            CASE WHEN mv < 240 THEN 1 WHEN mv < 360 THEN 2 WHEN mv < 480 THEN 3 ELSE 4 END AS pauses FROM h""",
    "pause_allocation": """WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_orderkey % 240 AS total, (l_orderkey % 240) * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS x FROM lineitem),
        f AS (SELECT *, floor(x) AS b, x - floor(x) AS rest FROM q),
        n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rest DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, total - sum(b) OVER (PARTITION BY l_orderkey) AS spare FROM f)
        SELECT l_orderkey, l_linenumber, l_partkey, CAST(b + CASE WHEN n - 1 < spare THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM n""",
    "clock_shifts": """WITH q AS (SELECT o_orderkey, CAST(floor(o_orderkey % 1440 + round(o_totalprice / 100, 2) + 0.5) AS BIGINT) AS a FROM orders)
        SELECT o_orderkey, CAST(a % 1440 AS INT) AS clock_minutes, CAST(a // 1440 AS INT) AS day_offset,
            lpad(CAST((a % 1440) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a % 60 AS VARCHAR), 2, '0') || CASE WHEN a >= 1440 THEN ' (+' || CAST(a // 1440 AS VARCHAR) || ' j)' ELSE '' END AS text,
            CAST((a + 1320) % 1440 AS INT) AS shifted, a >= 120 AS coherent, CAST(a % 1440 AS INT) AS parsed, TIMESTAMP '2024-03-30' + to_minutes(CAST(a AS INT)) AS at FROM q""",
    "hourly_summary": f"WITH {HOURLY_SQL} SELECT location_id, {SUMMARY} FROM hourly GROUP BY 1",
    "daily_summary": f"WITH {HOURLY_SQL} SELECT location_id, strftime(time, '%Y-%m-%d') AS date, {SUMMARY} FROM hourly GROUP BY 1, 2",
    "nearest_hours": f"WITH {NEAR_SQL} SELECT point_id, forecast_time, round(minutes_off, 8) AS minutes_off, apparent_c, weather_code FROM near",
    "ride_association": f"""WITH {NEAR_SQL} SELECT point_id, CASE WHEN location_id = 24 THEN 'location-missing' WHEN eta < TIMESTAMP '2024-01-02' OR eta > TIMESTAMP '2024-01-25' THEN 'outside-forecast'
        WHEN forecast_time IS NULL THEN 'hour-missing' ELSE 'available' END AS state, CASE WHEN location_id <> 24 THEN forecast_time END AS forecast_time FROM near""",
    "off_day_association": f"""WITH {HOURLY_SQL}, {STOPS_SQL}, d AS (SELECT day_id, min(location_id) AS location_id, CAST(min(eta) AS DATE) AS date FROM stops GROUP BY 1)
        SELECT day_id, count(*) AS hours, min(apparent_c) AS coldest, max(gust_kph) AS gust FROM d JOIN hourly h ON h.location_id = d.location_id AND CAST(h.time AS DATE) = d.date GROUP BY 1""",
    "hazard_findings": f"WITH {ALERTS_SQL} SELECT day_id, point_id, rank, risk, level, value FROM al",
    "alert_groups": f"WITH {ALERTS_SQL} SELECT * FROM groups",
    "day_risk": f"""WITH {ALERTS_SQL}, g AS (SELECT day_id, count(*) FILTER (level = 'red') AS red, count(*) FILTER (level = 'orange') AS orange, count(*) FILTER (level = 'red' AND upcoming) AS upcoming_red,
            count(*) FILTER (level = 'orange' AND upcoming) AS upcoming_orange FROM groups GROUP BY 1),
        c AS (SELECT day_id, count(forecast_time) AS covered, count(*) - count(forecast_time) AS missing, count(*) FILTER (kind <> 'poi') AS n, count(forecast_time) FILTER (kind <> 'poi') AS h FROM near GROUP BY 1),
        j AS (SELECT day_id, covered, missing, coalesce(red, 0) AS red, coalesce(orange, 0) AS orange, coalesce(upcoming_red, 0) AS upcoming_red, coalesce(upcoming_orange, 0) AS upcoming_orange,
            CASE WHEN n > 0 THEN h / n END AS coverage FROM c LEFT JOIN g USING (day_id)),
        k AS (SELECT *, CAST(coalesce(coverage < 0.8, false) AS BIGINT) + CAST(day_id % 13 + 0.5 > 6 AS BIGINT) AS unknown FROM j)
        SELECT * REPLACE (round(coverage, 6) AS coverage), CASE WHEN red > 0 THEN 'red' WHEN orange > 0 THEN 'orange' WHEN unknown > 0 THEN 'unknown' ELSE 'green' END AS level FROM k""",
    "live_progress": f"""WITH {STOPS_SQL}, o AS (SELECT day_id, point_id, eta > TIMESTAMP '2024-01-15 12:00:00' AS later, CAST(row_number() OVER (PARTITION BY day_id ORDER BY eta, point_id) AS INT) AS position FROM stops)
        SELECT day_id, point_id, position, CASE WHEN NOT later THEN 'past' WHEN position = min(position) FILTER (later) OVER (PARTITION BY day_id) THEN 'next' ELSE 'upcoming' END AS state FROM o""",
    "today_reference": f"""WITH {HOURLY_SQL}, t AS (SELECT location_id % 7 AS request, *, CASE weather_code WHEN 0 THEN 0 WHEN 3 THEN 3 WHEN 45 THEN 5 WHEN 61 THEN 5 WHEN 65 THEN 8 WHEN 80 THEN 6
            WHEN 95 THEN 10 WHEN 96 THEN 11 WHEN 7 THEN -1 END AS sev FROM hourly WHERE CAST(time AS DATE) = DATE '2024-01-10')
        SELECT request, round(min(apparent_c), 8) AS min_c, round(max(apparent_c + 5), 8) AS max_c, round(max(precipitation_mm), 8) AS rain_mm, round(max(precipitation_pct), 8) AS rain_pct,
            round(max(wind_kph), 8) AS wind_kph, round(max(gust_kph), 8) AS gust_kph, arg_max(weather_code, sev) AS worst_code FROM t GROUP BY 1""",
    "scenario_ranking": f"WITH {SCENARIO_SQL} SELECT * FROM ranked",
    "recommendations": f"""WITH {SCENARIO_SQL}, n AS (SELECT * FROM ranked WHERE "offset" = 0), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day_id ORDER BY rank) AS z FROM ranked WHERE coherent) WHERE z = 1),
        j AS (SELECT n.day_id, b."offset" AS o, n.coverage, n.day_id % 5 IN (0, 3) OR n.day_id % 5 IN (1, 4) AND n.day_id % 3 <> 0 AS open, n.day_id % 4 <> 0 AND n.day_id % 9 > 6 AS old, coalesce(n.red - b.red >= 1, false) OR coalesce(n.orange - b.orange >= 2, false) OR coalesce(n.rain_mm - b.rain_mm >= 2, false)
            OR coalesce(n.gust_kph - b.gust_kph >= 15, false) OR coalesce(b.exposed_c - n.exposed_c >= 5, false) AS better FROM n LEFT JOIN b USING (day_id))
        SELECT day_id, CASE WHEN NOT open THEN 'not-applicable' WHEN coalesce(coverage < 0.8, false) OR old THEN 'insufficient-data' WHEN o IS NULL OR o = 0 OR NOT better THEN 'keep-current' ELSE 'recommended-change' END AS status,
            CASE WHEN open AND NOT coalesce(coverage < 0.8, false) AND NOT old AND o <> 0 AND better THEN o END AS "offset" FROM j""",
    "weather_codes": f"""WITH {HOURLY_SQL} SELECT weather_code, count(*) AS hours, any_value(CASE weather_code WHEN 0 THEN 0 WHEN 3 THEN 3 WHEN 45 THEN 5 WHEN 61 THEN 5 WHEN 65 THEN 8 WHEN 80 THEN 6
        WHEN 95 THEN 10 WHEN 96 THEN 11 WHEN 7 THEN -1 END) AS severity FROM hourly GROUP BY 1""",
    "display_modes": f"""WITH {STOPS_SQL}, d AS (SELECT date_diff('day', DATE '2024-01-10', CAST(eta AS DATE)) AS a, location_id FROM stops)
        SELECT CASE WHEN a < 0 THEN 'past' WHEN a = 0 THEN 'live' WHEN location_id = 3 OR a > 12 THEN 'today-reference' WHEN a <= 2 THEN 'operational' WHEN a <= 7 THEN 'planning' ELSE 'trend' END AS mode, count(*) AS points FROM d GROUP BY 1""",
    "forecast_cache": """SELECT user_id % 60 AS request, max(ts) AS fetched_at, arg_max(event_id, ts) AS payload, (epoch_us(TIMESTAMP '2024-01-30 23:59:00') - epoch_us(max(ts))) / 60e6 <= 240 AS fresh FROM events GROUP BY 1""",
    "nearest_segments": f"WITH {SEGMENT_SQL} SELECT place_id, route_id, segment, {r('lateral_m', 'lateral_m', 3)}, {r('ratio', 'ratio', 3)} FROM nearest",
    "places_in_corridor": f"""WITH {SEGMENT_SQL}, n AS (SELECT DISTINCT place_id, CAST(route_id AS VARCHAR) AS route FROM proj WHERE lateral_m <= 1500)
        SELECT place_id, string_agg(route, ',' ORDER BY route) AS routes FROM n GROUP BY 1""",
    "unique_places": f"""WITH {SEGMENT_SQL} SELECT route_id, layer, place_id FROM (SELECT route_id, layer, place_id, row_number() OVER (PARTITION BY route_id, layer ORDER BY round(lateral_m, 4), place_id) AS z
        FROM nearest JOIN places USING (place_id)) WHERE z = 1""",
    "duplicate_files": "SELECT sha256(text) AS sha256, count(*) AS files, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "trip_totals": f"""WITH {DAYS_SQL} SELECT trip_id, count(*) AS days, count(*) FILTER (kind = 'ride') AS rides, count(*) FILTER (kind = 'off') AS offs, count(*) FILTER (kind = 'transfer') AS transfers,
        count(*) FILTER (NOT attached) AS calendar_days, round(sum(distance_km), 4) AS known_km, round(sum(coalesce(distance_km, 0.0)), 4) AS zero_km,
        round(CASE WHEN count(distance_km) = count(*) FILTER (kind = 'ride') THEN sum(distance_km) END, 4) AS complete_km, round(sum(gain_m), 4) AS gain_m FROM days GROUP BY 1""",
    "trip_calendar": f'WITH {DAYS_SQL} SELECT trip_id, day_id, "index", display_number, CAST(date AS VARCHAR) AS date FROM dated',
    "trip_fill_places": f"""WITH {DAYS_SQL}, n AS (SELECT d.*, (SELECT max(x.position) FROM days x WHERE x.trip_id = d.trip_id AND x.kind = 'ride' AND x.position < d.position) AS b,
            (SELECT min(x.position) FROM days x WHERE x.trip_id = d.trip_id AND x.kind = 'ride' AND x.position > d.position) AS a FROM days d WHERE kind <> 'ride')
        SELECT n.trip_id, n.position, CASE WHEN n.manual IS NOT NULL THEN n.manual WHEN n.b IS NOT NULL THEN x.arrival ELSE y.departure END AS place,
            CASE WHEN n.manual IS NOT NULL THEN 'manual' WHEN n.b IS NOT NULL THEN 'previous' WHEN n.a IS NOT NULL THEN 'next' ELSE 'none' END AS source
        FROM n LEFT JOIN days x ON x.trip_id = n.trip_id AND x.position = n.b LEFT JOIN days y ON y.trip_id = n.trip_id AND y.position = n.a""",
    "trip_progress": f"""WITH {DAYS_SQL} SELECT trip_id, count(*) FILTER (date < DATE '2024-06-08') AS days_done, count(*) FILTER (date >= DATE '2024-06-08') AS days_left,
        round(sum(CASE WHEN date < DATE '2024-06-08' THEN coalesce(distance_km, 0.0) ELSE 0.0 END), 4) AS km_done, round(sum(coalesce(distance_km, 0.0)), 4) AS km_total,
        CAST(min(date) FILTER (date >= DATE '2024-06-08') AS VARCHAR) AS next_date FROM dated GROUP BY 1""",
    "trip_highlight": f"WITH {DAYS_SQL} SELECT trip_id, arg_min(position, date) FILTER (date >= DATE '2024-06-12') AS position FROM dated GROUP BY 1",
    "trip_preferred": f"""WITH {DAYS_SQL}, s AS (SELECT trip_id, trip_id % 20 AS owner, min(order_date) AS a, max(order_date) AS b FROM days GROUP BY 1),
        t AS (SELECT *, CASE WHEN a <= DATE '1995-06-17' AND b >= DATE '1995-06-17' THEN 0 WHEN a > DATE '1995-06-17' THEN 1 ELSE 2 END AS stage FROM s),
        u AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY stage, CASE stage WHEN 2 THEN DATE '1995-06-17' - b WHEN 1 THEN a - DATE '1995-06-17' ELSE 0 END, trip_id) AS z FROM t)
        SELECT owner, trip_id, stage FROM u WHERE z = 1""",
    "reference_points": f"""WITH {STOPS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY day_id ORDER BY eta, point_id) AS a, row_number() OVER (PARTITION BY day_id ORDER BY eta DESC, point_id DESC) AS c,
            row_number() OVER (PARTITION BY day_id ORDER BY (kind = 'col') DESC, elevation_m DESC, point_id) AS b FROM stops)
        SELECT day_id, point_id FROM p WHERE a = 1 OR c = 1 OR (b = 1 AND kind = 'col')""",
    "stage_members": """WITH i AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INT) AS pos, l_partkey + CASE WHEN l_linenumber = 3 THEN 10000000 ELSE 0 END AS k FROM lineitem)
        SELECT l_orderkey, pos, p_partkey, p_size FROM i JOIN part ON p_partkey = k""",
    "days_of_place": "SELECT l_orderkey % 30 AS day, count(DISTINCT l_suppkey) AS places FROM lineitem WHERE l_orderkey % 30 < 10 GROUP BY 1",
    "planned_files": """WITH p AS (SELECT 'f' || CAST(o_custkey AS VARCHAR) AS file_name, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT 'f' || CAST(c_custkey AS VARCHAR) AS file_name, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1)
        SELECT coalesce(p.file_name, f.file_name) AS file_name, coalesce(p.n, 0) AS planned, coalesce(f.n, 0) AS present,
            CASE WHEN p.n IS NULL THEN 'unplanned' WHEN f.n IS NULL THEN 'missing' WHEN p.n > 1 OR f.n > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM p FULL JOIN f ON p.file_name = f.file_name""",
    "upsert": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE 'old' END AS version FROM customer",
    "unique_name_matches": """WITH u AS (SELECT p_partkey % 1300 AS k, min(p_partkey) AS p_partkey FROM part GROUP BY 1 HAVING count(*) = 1) SELECT s_suppkey, p_partkey FROM supplier JOIN u ON s_suppkey * 13 % 1300 = k""",
    "enrichment_status": """SELECT user_id * 20 + event_id % 20 AS request, count(*) AS parts, count(*) FILTER (event_type <> 'error') AS good,
        CASE WHEN count(*) = count(*) FILTER (event_type <> 'error') THEN 'success' WHEN count(*) FILTER (event_type <> 'error') > 0 THEN 'partial' ELSE 'error' END AS status FROM events GROUP BY 1""",
    "layer_counts": f"WITH {PLACES_SQL} SELECT layer, count(*) AS places, count(name) AS named, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM places GROUP BY 1",
    "version_difference": """WITH a AS (SELECT p_partkey, p_size, p_brand FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size, p_brand FROM part WHERE p_partkey % 11 <> 0)
        SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_size IS DISTINCT FROM b.p_size OR a.p_brand IS DISTINCT FROM b.p_brand""",
    "validation_issues": f"""WITH {DAYS_SQL}, x AS (SELECT day_id, trip_id, position, position - 1 + CASE WHEN day_id % 70 = 0 THEN 1 ELSE 0 END AS i, position * 10 - CASE WHEN day_id % 80 = 0 THEN 10 ELSE 0 END AS km FROM days)
        SELECT CAST(o_orderkey AS VARCHAR) AS id, 'price-range' AS code FROM orders WHERE o_totalprice > 400000
        UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'bad-priority' FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'
        UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'duplicate-id' FROM orders WHERE o_orderkey % 500 = 0
        UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'unknown-reference' FROM orders WHERE o_orderkey % 90 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT CAST(day_id AS VARCHAR), 'index-gap' FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY i, day_id) - 1 AS z FROM x) WHERE z <> i
        UNION ALL SELECT CAST(day_id AS VARCHAR), 'not-increasing' FROM (SELECT *, lag(km) OVER (PARTITION BY trip_id ORDER BY position) AS b FROM x) WHERE km <= b""",
    "schema_versions": """WITH v AS (SELECT CASE WHEN p_size % 9 <> 0 THEN p_size % 9 - 1 END AS v FROM part)
        SELECT CASE WHEN v = 5 THEN 'current' WHEN v > 5 THEN 'future' WHEN v IS NULL OR v < 1 THEN 'invalid' WHEN v >= 2 THEN 'migrate' ELSE 'no-migration' END AS status, count(*) AS bundles FROM v GROUP BY 1""",
    "expanded_boxes": f"""WITH {POINTS_SQL}, b AS (SELECT route_id, min(latitude) AS s, min(longitude) AS w, max(latitude) AS n, max(longitude) AS e FROM track_points GROUP BY 1)
        SELECT route_id, round(greatest(-90.0, s - 500.0::DOUBLE / 111320), 6) AS south, round(greatest(-180.0, w - 500.0::DOUBLE / 111320 / greatest(0.1, cos(radians((s + n) / 2)))), 6) AS west,
            round(least(90.0, n + 500.0::DOUBLE / 111320), 6) AS north, round(least(180.0, e + 500.0::DOUBLE / 111320 / greatest(0.1, cos(radians((s + n) / 2)))), 6) AS east FROM b""",
    "summit_names": f"""WITH {PLACES_SQL}, c AS (SELECT *, CASE place_id % 3 WHEN 0 THEN 'mountain-pass' WHEN 1 THEN 'saddle' ELSE 'peak' END AS kind, CASE WHEN place_id % 4 <> 0 THEN place_id % 300 END AS e FROM places),
        s AS (SELECT s_suppkey AS climb_id, 45.0::DOUBLE + (s_suppkey % 150) * 0.01::DOUBLE + (s_suppkey % 50) * 0.0003::DOUBLE AS lat, 6.0::DOUBLE + (s_suppkey % 50) * 0.0003::DOUBLE AS lon,
            CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 280 END AS se FROM supplier),
        d AS (SELECT *, 6371000::DOUBLE * sqrt(pow(radians(longitude - lon) * cos(radians((latitude + lat) / 2)), 2) + pow(radians(latitude - lat), 2)) AS far, coalesce(abs(e - se), 0) AS up FROM s JOIN c ON abs(latitude - lat) < 0.01),
        n AS (SELECT *, row_number() OVER (PARTITION BY climb_id ORDER BY CASE kind WHEN 'mountain-pass' THEN 0 WHEN 'saddle' THEN 1 ELSE 2 END, far, place_id) AS n FROM d WHERE kind = 'mountain-pass' AND far <= 250 AND up <= 120
            OR kind = 'saddle' AND far <= 300 AND up <= 120 OR kind = 'peak' AND far <= CASE WHEN e IS NULL THEN 40 ELSE 75 END AND up <= 60)
        SELECT climb_id, place_id AS candidate_id, name FROM n WHERE n = 1""",
    "custom_pauses": """SELECT l_orderkey AS day_id, l_suppkey * 13 % 131 AS place_id, arg_min(l_partkey, l_linenumber * 1000000000000 + l_partkey) AS pause_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS minutes
        FROM lineitem WHERE l_returnflag <> 'A' AND CAST(l_quantity AS BIGINT) > 0 AND l_suppkey * 13 % 131 IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2""",
    "stable_place_ids": f"""WITH {PLACES_SQL}, b AS (SELECT place_id, 'place-' || substr(sha256(layer || '|' || coalesce(lower(name), '') || '|' || printf('%.7f', round(latitude, 1)) || '|6.0000000'), 1, 14) AS b FROM places),
        n AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY place_id) AS n FROM b) SELECT place_id, b || CASE WHEN n > 1 THEN '-' || CAST(n AS VARCHAR) ELSE '' END AS stable_id FROM n""",
    "endpoint_names": """WITH p AS (SELECT o_custkey % 100 AS route_id, o_orderkey AS point_id, o_orderstatus IN ('F', 'O') AS locality, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 0 END AS named,
            round(o_totalprice % 20, 2) AS km FROM orders)
        SELECT route_id, point_id FROM p WHERE NOT (locality AND (named = 1 AND route_id % 3 <> 0 AND km <= 2 OR named = 2 AND route_id % 2 = 0 AND km >= 18))""",
    "waypoint_visibility": """WITH q AS (SELECT l_quantity / 8 AS km, l_quantity * 9 AS m, l_quantity / 7 AS g, l_linenumber % 5 = 0 AS named, l_returnflag = 'R' AS paused,
            CASE l_linenumber % 4 WHEN 0 THEN 'town' WHEN 1 THEN 'saddle' ELSE 'climb' END AS kind FROM lineitem),
        i AS (SELECT *, CASE WHEN named OR (km >= 1.5 AND m >= 100 AND g >= 2) OR (km >= 1.0 AND m >= 60 AND g >= 3) OR (km >= 0.5 AND m >= 40 AND g >= 4) THEN 'major' ELSE 'secondary' END AS rolling, CASE WHEN named OR (km >= 4 AND m >= 300 AND g >= 3) OR (km >= 1.5 AND m >= 150 AND g >= 6) THEN 'major' ELSE 'secondary' END AS mountain FROM q)
        SELECT kind, rolling, mountain, paused OR kind = 'saddle' OR (kind = 'climb' AND mountain = 'major') AS visible, count(*) AS waypoints FROM i GROUP BY 1, 2, 3, 4""",
    "documented_points": """SELECT o_orderkey, CASE WHEN o_orderkey % 2000 <= 250 THEN 'matched' WHEN o_orderkey % 2000 <= 1000 THEN 'needs-review' ELSE 'unmatched' END AS status,
        CASE WHEN o_orderkey % 7 <> 0 THEN 1000.0::DOUBLE + o_custkey % 1000 + CASE WHEN o_orderkey % 3 = 0 THEN 0.5::DOUBLE ELSE 0 END END AS elevation_m, CASE o_orderstatus WHEN 'F' THEN 250.0::DOUBLE WHEN 'O' THEN 1500.0::DOUBLE END AS reach_m FROM orders""",
    "track_nearest_samples": f"""WITH {STEPS_SQL}, l AS (SELECT route_id, min(seq) AS a, max(seq) AS b, max(distance_km) AS km FROM series GROUP BY 1),
        t AS (SELECT route_id, km, unnest(range(1, CAST(floor(km / 0.25) AS BIGINT) + 1)) * 0.25::DOUBLE AS t FROM l)
        SELECT DISTINCT route_id, seq FROM (SELECT t.route_id, arg_min(s.seq, abs(s.distance_km - t.t)) AS seq FROM t JOIN series s ON s.route_id = t.route_id WHERE t.t < t.km - 1e-9 GROUP BY t.route_id, t.t
            UNION ALL SELECT route_id, a FROM l UNION ALL SELECT route_id, b FROM l)""",
    "automatic_pauses": """WITH d AS (SELECT l_orderkey AS day_id, sum(l_quantity) AS km, l_orderkey % 100 AS b FROM lineitem GROUP BY 1, 3),
        r AS (SELECT day_id, b, i, rule, km * place AS km, floor(b * part) AS f, b * part - floor(b * part) AS rest FROM d CROSS JOIN (VALUES (0, 'morning', 0.25::DOUBLE, 0.25::DOUBLE), (1, 'main', 0.5::DOUBLE, 0.5::DOUBLE),
            (2, 'afternoon', 0.75::DOUBLE, 0.25::DOUBLE)) v(i, rule, place, part) WHERE km > 0 AND b > 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY day_id ORDER BY rest DESC, i) AS n, b - sum(f) OVER (PARTITION BY day_id) AS spare FROM r),
        a AS (SELECT day_id, rule, round(km, 6) + 0.0 AS km, CAST(f + CASE WHEN n - 1 < spare THEN 1 ELSE 0 END AS BIGINT) AS minutes FROM n) SELECT * FROM a WHERE minutes > 0""",
    "documented_totals": f"""WITH {DAYS_SQL} SELECT trip_id, CASE WHEN count(distance_km) = count(*) THEN round(sum(distance_km), 4) + 0.0 END AS distance_km, CASE WHEN count(gain_m) = count(*) THEN round(sum(gain_m), 4) + 0.0 END AS gain_m
        FROM days GROUP BY 1""",
    "day_slots": f"""WITH {DAYS_SQL} SELECT trip_id, day_id, count(*) OVER w - 1 AS "index", CASE WHEN kind = 'ride' THEN count(*) FILTER (kind = 'ride') OVER w END AS ride_number FROM days
        WINDOW w AS (PARTITION BY trip_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "job_states": """SELECT user_id, last(event_type ORDER BY ts, event_id) AS status, last(event_id ORDER BY ts, event_id) FILTER (event_type = 'click') AS progress, count(*) AS steps FROM events GROUP BY 1""",
    "primary_alerts": f"""WITH {ALERTS_SQL}, m AS (SELECT day_id, point_id AS main FROM (SELECT *, row_number() OVER (PARTITION BY day_id ORDER BY elevation_m DESC, point_id) AS n FROM stops WHERE kind IN ('col', 'summit')) WHERE n = 1),
        n AS (SELECT al.*, row_number() OVER (PARTITION BY al.day_id ORDER BY level = 'red' DESC, coalesce(point_id = main, false) DESC, eta, ord) AS n FROM al LEFT JOIN m ON m.day_id = al.day_id WHERE level IN ('red', 'orange'))
        SELECT day_id, point_id, risk, level, eta FROM n WHERE n = 1""",
    "retained_forecasts": """WITH q AS (SELECT *, last_value(CASE WHEN event_type <> 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM events)
        SELECT event_id, p AS payload, event_type = 'error' AND p IS NOT NULL AS retained FROM q""",
}


WAYPOINT_SQL = """w AS (SELECT l_orderkey AS route_id, CAST(l_linenumber AS BIGINT) AS waypoint_id, ['city', 'town', 'village', 'mountain-pass', 'saddle', 'climb', 'start'][l_suppkey % 7 + 1] AS kind,
        round((l_partkey * 7 % 1000) / 10.0::DOUBLE, 1) AS km FROM lineitem), o AS (SELECT o_orderkey AS route_id FROM orders),
    c AS (SELECT *, CASE kind WHEN 'city' THEN 0 WHEN 'town' THEN 1 WHEN 'village' THEN 2 WHEN 'mountain-pass' THEN 3 WHEN 'saddle' THEN 3 END AS p FROM w)"""
PRIORITY = """CASE kind WHEN 'start' THEN 0 WHEN 'end' THEN 0 WHEN 'mountain-pass' THEN 1 WHEN 'saddle' THEN 2 WHEN 'city' THEN 3 WHEN 'town' THEN 4 WHEN 'climb' THEN 5 WHEN 'village' THEN 6 WHEN 'pause' THEN 7 END"""
PLACED_SQL = """p0 AS (SELECT o.route_id, 0 AS position, coalesce(b.km, 25.0) AS km, 10 AS minutes, b.waypoint_id FROM o LEFT JOIN (
        SELECT c.*, row_number() OVER (PARTITION BY route_id ORDER BY p, abs(km - 25), waypoint_id) AS z FROM c WHERE p IS NOT NULL AND km BETWEEN 8 AND 92 AND abs(km - 25) <= 12 
    ) b ON b.route_id = o.route_id AND b.z = 1), p1 AS (SELECT o.route_id, 1 AS position, coalesce(b.km, 50.0) AS km, 20 AS minutes, b.waypoint_id FROM o LEFT JOIN (
        SELECT c.*, row_number() OVER (PARTITION BY route_id ORDER BY p, abs(km - 50), waypoint_id) AS z FROM c WHERE p IS NOT NULL AND km BETWEEN 8 AND 92 AND abs(km - 50) <= 12 AND NOT EXISTS (SELECT 1 FROM p0 WHERE p0.route_id = c.route_id AND (abs(p0.km - c.km) < 8 OR p0.waypoint_id = c.waypoint_id))
    ) b ON b.route_id = o.route_id AND b.z = 1), p2 AS (SELECT o.route_id, 2 AS position, coalesce(b.km, 75.0) AS km, 10 AS minutes, b.waypoint_id FROM o LEFT JOIN (
        SELECT c.*, row_number() OVER (PARTITION BY route_id ORDER BY p, abs(km - 75), waypoint_id) AS z FROM c WHERE p IS NOT NULL AND km BETWEEN 8 AND 92 AND abs(km - 75) <= 12 AND NOT EXISTS (SELECT 1 FROM p0 WHERE p0.route_id = c.route_id AND (abs(p0.km - c.km) < 8 OR p0.waypoint_id = c.waypoint_id)) AND NOT EXISTS (SELECT 1 FROM p1 WHERE p1.route_id = c.route_id AND (abs(p1.km - c.km) < 8 OR p1.waypoint_id = c.waypoint_id))
    ) b ON b.route_id = o.route_id AND b.z = 1),
    placed AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)"""
UNUSED_SQL = """p0 AS (SELECT route_id, 0 AS position, place_id, km FROM (
        SELECT c.*, row_number() OVER (PARTITION BY route_id ORDER BY abs(km - 25), place_id, km) AS z FROM c WHERE true ) WHERE z = 1), p1 AS (SELECT route_id, 1 AS position, place_id, km FROM (
        SELECT c.*, row_number() OVER (PARTITION BY route_id ORDER BY abs(km - 50), place_id, km) AS z FROM c WHERE true AND NOT EXISTS (SELECT 1 FROM p0 WHERE p0.route_id = c.route_id AND p0.place_id = c.place_id)) WHERE z = 1), p2 AS (SELECT route_id, 2 AS position, place_id, km FROM (
        SELECT c.*, row_number() OVER (PARTITION BY route_id ORDER BY abs(km - 75), place_id, km) AS z FROM c WHERE true AND NOT EXISTS (SELECT 1 FROM p0 WHERE p0.route_id = c.route_id AND p0.place_id = c.place_id) AND NOT EXISTS (SELECT 1 FROM p1 WHERE p1.route_id = c.route_id AND p1.place_id = c.place_id)) WHERE z = 1)"""
WEIGHTED_SQL = f"""{SLOPES_SQL}, wb AS (SELECT *, (slope + coalesce(lag(slope) OVER (PARTITION BY route_id ORDER BY seq), slope)) / 2 AS m FROM slopes),
    weighted AS (SELECT route_id, seq, distance_km AS track_km, sum(step_km / ({MULTIPLIER.format("m")})) OVER (PARTITION BY route_id ORDER BY seq) AS distance_km FROM wb)"""
LABELS = "CASE weather_code " + " ".join(f"WHEN {c} THEN '{name}'" for c, name in ((0, "Ciel dégagé"), (3, "Couvert"), (45, "Brouillard"), (61, "Pluie faible"), (65, "Pluie forte"), (80, "Averses faibles"), (95, "Orage"), (96, "Orage avec grêle faible"))) + " ELSE 'Conditions non identifiées' END"
STAGE_SQL = {
    "stage_timing": f"""WITH {TIMED_SQL}, a AS (SELECT route_id, max(moving_minutes) AS m, max(distance_km) AS km FROM timed GROUP BY 1),
        b AS (SELECT route_id, km, 100.0 + route_id AS gain, CASE WHEN route_id % 7 <> 0 AND m IS NOT NULL AND km > 0 THEN m ELSE km / 18 * 60 END AS m, CASE WHEN route_id % 3 <> 0 THEN route_id % 5 * 10 END AS b FROM a),
        s AS (SELECT *, CAST(floor(m * 60 + 0.5) AS BIGINT) AS moving_s FROM b), h AS (SELECT *, moving_s / 3600.0::DOUBLE AS h FROM s),
        p AS (SELECT *, coalesce(b, CASE WHEN km > 0 AND moving_s > 0 THEN greatest(0.0, least(240.0, floor(h * greatest(3.6, least(16.0, 3.6 + 1.295 * h))
            * (1 + greatest(0.0, least(60.0, greatest(0.0, gain) / km - 5)) / 60 * 0.8) / 5 + 0.5) * 5)) ELSE 0 END) AS brk FROM h)
        SELECT route_id, CAST(brk AS DOUBLE) AS break_minutes, moving_s, CAST(floor(brk * 60 + 0.5) AS BIGINT) AS pause_s, moving_s + CAST(floor(brk * 60 + 0.5) AS BIGINT) AS total_s,
            round(CASE WHEN m > 0 THEN km / (m / 60) END, 3) AS average_kph FROM p""",
    "pause_settings": """SELECT l_orderkey AS stage_id, l_linenumber AS pause_id, l_suppkey AS point_id, CAST(floor(l_quantity * 37 / 60 + 0.5) AS INT) AS minutes,
            CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 4, l_linenumber, l_suppkey, floor(l_quantity * 37 / 60 + 0.5)) AS INT) AS position
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 3 <> 1 AND l_returnflag <> 'R' AND l_suppkey % 5 <> 0""",
    "placed_pauses": f"WITH {WAYPOINT_SQL}, {PLACED_SQL} SELECT route_id, position, round(km, 4) AS km, minutes, waypoint_id FROM placed",
    "unused_places": f"WITH {WAYPOINT_SQL.replace('AS waypoint_id', 'AS place_id')}, {UNUSED_SQL} SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2",
    "paused_waypoints": f"""WITH {WAYPOINT_SQL}, {PLACED_SQL}, u AS (SELECT w.route_id, w.waypoint_id, kind, w.km, minutes AS pause_minutes FROM w LEFT JOIN placed q ON q.route_id = w.route_id AND q.waypoint_id = w.waypoint_id
            UNION ALL SELECT route_id, NULL, 'pause', km, minutes FROM placed WHERE waypoint_id IS NULL)
        SELECT route_id, CAST(row_number() OVER (PARTITION BY route_id ORDER BY km, {PRIORITY} NULLS LAST, waypoint_id NULLS FIRST) AS INT) AS position, waypoint_id, kind, round(km, 4) AS km,
            round(45.0::DOUBLE + km * 0.01::DOUBLE, 4) AS latitude, round(500.0::DOUBLE + km, 4) AS elevation_m, pause_minutes FROM u""",
    "slot_edits": """WITH s AS (SELECT l_orderkey AS t, list(k ORDER BY l_linenumber, k) AS a FROM (SELECT *, CASE l_suppkey % 4 WHEN 0 THEN 'off' WHEN 1 THEN 'transfer' ELSE 'ride' END AS k FROM lineitem) GROUP BY 1),
        i AS (SELECT *, CAST(least(greatest(t % 9 - 1, 0), len(a)) AS INT) AS n, CAST(t % 8 - 1 AS INT) AS p, CAST(t % 7 - 1 AS INT) AS f, CAST(t % 7 - 1 + CASE WHEN t % 2 = 0 THEN 1 ELSE -1 END AS INT) AS g FROM s)
        SELECT t AS trip_id, array_to_string(a[1:n] || ['off'] || a[n + 1:], ',') AS inserted,
            CASE WHEN p < 0 OR p >= len(a) THEN array_to_string(a, ',') WHEN a[p + 1] <> 'ride' THEN array_to_string(a[1:p] || a[p + 2:], ',') END AS removed,
            CASE WHEN f < 0 OR f >= len(a) OR g < 0 OR g >= len(a) THEN array_to_string(a, ',')
                ELSE array_to_string(list_transform(range(0, len(a)), lambda x: CASE WHEN x = f THEN a[g + 1] WHEN x = g THEN a[f + 1] ELSE a[x + 1] END), ',') END AS moved FROM i""",
    "time_markers": f"""WITH {WEIGHTED_SQL}, asked AS (SELECT route_id, k, k * 0.6::DOUBLE AS t FROM (SELECT route_id, unnest(range(1, CAST(ceil(max(distance_km) / 0.6::DOUBLE - 1e-9) AS INT))) AS k FROM weighted GROUP BY 1) WHERE k <> 2),
        {at_sql("weighted", "track_km", "asked", "mk")}
        SELECT route_id, CAST(row_number() OVER (PARTITION BY route_id ORDER BY k) AS INT) AS marker, round(k * 0.6::DOUBLE, 4) AS weighted_km, round(v, 4) AS track_km FROM mk""",
    "altitudes_between": f"""WITH {STEPS_SQL}, known AS (SELECT route_id, distance_km, elevation_m FROM series WHERE elevation_m IS NOT NULL), e AS (SELECT route_id, max(distance_km) AS t FROM series GROUP BY 1),
        sp AS (SELECT route_id, i AS k, t * a AS low, t * b AS high FROM e CROSS JOIN (VALUES (0, 0.1::DOUBLE, 0.35::DOUBLE), (1, 0.3::DOUBLE, 0.8::DOUBLE), (2, 0.9::DOUBLE, 1.0::DOUBLE)) v(i, a, b)),
        lo AS (SELECT route_id, k, low AS t FROM sp), hi AS (SELECT route_id, k, high AS t FROM sp), {at_sql("known", "elevation_m", "lo", "lv")}, {at_sql("known", "elevation_m", "hi", "hv")},
        u AS (SELECT lv.route_id, lv.k, low AS d, v AS e, 0 AS z FROM lv JOIN sp USING (route_id, k) UNION ALL SELECT hv.route_id, hv.k, high, v, 2 FROM hv JOIN sp USING (route_id, k)
            UNION ALL SELECT sp.route_id, sp.k, distance_km, elevation_m, 1 FROM sp JOIN known ON known.route_id = sp.route_id AND distance_km > low AND distance_km < high),
        x AS (SELECT *, e - lag(e) OVER (PARTITION BY route_id, k ORDER BY d, z) AS up FROM u)
        SELECT route_id, k, round(min(e), 4) AS lowest_m, round(max(e), 4) AS highest_m, round(coalesce(sum(greatest(up, 0.0)), 0), 4) + 0.0 AS gain_m FROM x GROUP BY 1, 2""",
    "route_fingerprints": f"""WITH {POINTS_SQL}, f AS (SELECT route_id, CASE WHEN route_id % 3 = 0 THEN 'sha256:' || sha256(CAST(route_id AS VARCHAR))
            ELSE 'route:' || CAST(route_id AS VARCHAR) || ':' || CASE WHEN count(*) < 2 THEN 'no-geometry' ELSE string_agg(printf('%.6f,%.6f', latitude, longitude), ';' ORDER BY seq) END END AS x FROM track_points GROUP BY 1)
        SELECT route_id, CAST(length(x) AS INT) AS length, md5(x) AS md5 FROM f""",
    "column_keys": "SELECT c_custkey, trim(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') AS key FROM customer",
    "weather_labels": f"WITH {HOURLY_SQL} SELECT {LABELS} AS label, count(*) AS hours FROM hourly GROUP BY 1",
    "trip_periods": """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT CASE WHEN d < DATE '1994-03-01' THEN 'before' WHEN d > DATE '1997-06-30' THEN 'after' ELSE 'during' END AS kind, count(*) AS orders,
        CAST(sum(CASE WHEN d < DATE '1994-03-01' THEN 1 WHEN d > DATE '1997-06-30' THEN date_diff('day', DATE '1994-03-01', DATE '1997-06-30') + 1 ELSE date_diff('day', DATE '1994-03-01', d) + 1 END) AS BIGINT) AS days,
        CAST(sum(CASE WHEN d < DATE '1994-03-01' THEN date_diff('day', d, DATE '1994-03-01') END) AS BIGINT) AS until FROM d GROUP BY 1""",
    "waypoint_order": f"WITH {WAYPOINT_SQL} SELECT route_id, waypoint_id, CAST(row_number() OVER (PARTITION BY route_id ORDER BY floor(km / 20), {PRIORITY} NULLS LAST, waypoint_id) AS INT) AS position FROM w",
    "point_roles": """WITH r AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'weather-reference' WHEN o_orderstatus = 'F' THEN 'route-point' ELSE 'information' END AS role, o_orderkey % 2 = 0 AS planned FROM orders)
        SELECT role, role = 'route-point' OR (role = 'weather-reference' AND planned) AS counts, count(*) AS points FROM r GROUP BY 1, 2""",
    "relation_issues": """SELECT CAST(o_orderkey AS VARCHAR) AS id, 'relation-not-mutual' AS code FROM orders WHERE o_orderkey % 50 <> 0 AND (o_orderkey % 70 = 0 OR o_orderkey % 30 = 0)
        UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'total-mismatch' FROM orders WHERE o_orderkey % 90 = 0
        UNION ALL SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR), 'duplicate-order' FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_partkey % 6) AS n FROM lineitem) WHERE n > 1""",
}
SQL |= STAGE_SQL


def thin_sql(source: str, within: str) -> str:
    """CTEs: the rows of `source` (route_id, grp, place_id, latitude, longitude, lateral_m) kept greedily, none within so many metres of another."""
    near = f"""len(list_filter(p.kept, lambda x: sqrt(pow((radians(n.longitude) - radians(x.lo)) * cos((radians(n.latitude) + radians(x.la)) / 2), 2)
        + pow(radians(n.latitude) - radians(x.la), 2)) * 6371000.0::DOUBLE <= {within}))"""
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY route_id, grp ORDER BY lateral_m, place_id) AS n FROM {source}),
        p AS (SELECT route_id, grp, n, place_id, [struct_pack(la := latitude, lo := longitude)] AS kept, true AS take FROM n WHERE n = 1 UNION ALL
            SELECT n.route_id, n.grp, n.n, n.place_id, CASE WHEN {near} = 0 THEN list_append(p.kept, struct_pack(la := n.latitude, lo := n.longitude)) ELSE p.kept END, {near} = 0
            FROM p JOIN n ON n.route_id = p.route_id AND n.grp = p.grp AND n.n = p.n + 1)"""


LOCATED_SQL = f"""{SEGMENT_SQL}, located AS (SELECT route_id, round(lateral_m, 4) AS lateral_m, place_id, name, latitude, longitude, place_id % 2 = 0 AS repair, place_id * 7 % 500 AS source_id,
    ['water', 'toilet', 'bike-service', 'bakery', 'shelter'][place_id % 5 + 1] AS category FROM nearest JOIN places USING (place_id))"""
SQL |= {
    "thinned_places": f"""WITH RECURSIVE {LOCATED_SQL}, t AS (SELECT *, name AS grp FROM located WHERE name IS NOT NULL), {thin_sql("t", "40")} SELECT place_id, route_id FROM p WHERE take""",
    "corridor_places": f"""WITH RECURSIVE {LOCATED_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY route_id, source_id ORDER BY lateral_m, place_id) AS z FROM located
            WHERE lateral_m <= 240 AND (name IS NOT NULL OR category IN ('water', 'toilet', 'shelter') OR category = 'bike-service' AND repair)),
        t AS (SELECT *, CASE WHEN name IS NOT NULL THEN 'n:' || name ELSE 'c:' || category END AS grp FROM s WHERE z = 1), {thin_sql("t", "CASE WHEN n.name IS NULL THEN 5 ELSE 40 END")}
        SELECT route_id, place_id FROM p WHERE take""",
    "corridor_features": f"""WITH RECURSIVE {LOCATED_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY route_id, source_id ORDER BY lateral_m, place_id) AS z FROM located
            WHERE lateral_m <= CASE WHEN category = 'water' THEN 150 ELSE 250 END),
        t AS (SELECT *, CASE WHEN category = 'water' THEN 'peak:' ELSE 'saddle:' END || name AS grp FROM s WHERE z = 1 AND name IS NOT NULL), {thin_sql("t", "25")}
        SELECT route_id, place_id FROM p WHERE take UNION ALL SELECT route_id, place_id FROM s WHERE z = 1 AND name IS NULL""",
    "nearest_named": f"""WITH {PLACES_SQL}, q AS (SELECT a.place_id % 150 AS route_id, a.place_id AS top_id, b.place_id AS point_id, b.name, {hav("a.latitude + 0.0004::DOUBLE", "a.longitude", "b.latitude", "b.longitude")} AS far_km
            FROM places a JOIN places b ON a.place_id % 150 = b.place_id % 150 AND b.name IS NOT NULL),
        z AS (SELECT *, row_number() OVER (PARTITION BY top_id ORDER BY far_km, point_id) AS z FROM q WHERE far_km <= 0.08) SELECT route_id, top_id, round(far_km, 4) AS far_km, point_id, name FROM z WHERE z = 1""",
    "largest_deviation": f"""WITH {POINTS_SQL}, s AS (SELECT * FROM (SELECT *, max(seq) OVER (PARTITION BY route_id) AS m FROM track_points) WHERE seq % 9 = 0 OR seq = m),
        g AS (SELECT route_id, latitude AS lat1, longitude AS lon1, lead(latitude) OVER w AS lat2, lead(longitude) OVER w AS lon2 FROM s WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
        f AS (SELECT t.route_id, seq, (lon2 - lon1) * xs AS ex, (lat2 - lat1) * ys AS ey, (longitude - lon1) * xs AS px, (latitude - lat1) * ys AS py FROM (SELECT t.route_id, t.seq, t.latitude, t.longitude, g.lat1, g.lon1, g.lat2, g.lon2,
            cos(radians((lat1 + lat2 + t.latitude) / 3)) * (6371000.0::DOUBLE * {PI} / 180) AS xs, 6371000.0::DOUBLE * {PI} / 180 AS ys FROM track_points t JOIN g ON g.route_id = t.route_id AND lat2 IS NOT NULL) t),
        d AS (SELECT route_id, seq, min(sqrt(pow(px - r * ex, 2) + pow(py - r * ey, 2))) AS far FROM (SELECT *, CASE WHEN ex * ex + ey * ey = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (px * ex + py * ey) / (ex * ex + ey * ey))) END AS r FROM f) GROUP BY 1, 2),
        a AS (SELECT route_id, count(*) AS n FROM track_points GROUP BY 1)
        SELECT a.route_id, round(CASE WHEN count(*) FILTER (far <= 500) = a.n THEN max(far) END, 4) + 0.0 AS deviation_m FROM a LEFT JOIN d USING (route_id) GROUP BY a.route_id, a.n""",
}
SQL |= {
    "positions_at": f"""WITH {TIMED_SQL}, mv AS (SELECT route_id, k, moving_minutes AS distance_km, distance_km AS track_km, smoothed_m FROM timed WHERE smoothed_m IS NOT NULL), e AS (SELECT route_id, max(moving_minutes) + 3 AS total FROM timed WHERE smoothed_m IS NOT NULL GROUP BY 1),
        a AS (SELECT route_id, CAST(i AS INT) AS k, least(greatest(x, 0.0), total) AS x FROM e CROSS JOIN (VALUES (0, -1.0::DOUBLE), (1, 0.5::DOUBLE), (2, 1.5::DOUBLE), (3, 2.5::DOUBLE), (4, 4.0::DOUBLE), (5, 6.0::DOUBLE), (6, 7.5::DOUBLE)) v(i, x)),
        mo AS (SELECT route_id, k, x BETWEEN 1 AND 2 OR x BETWEEN 3 AND 5 AS paused, CASE WHEN x BETWEEN 1 AND 2 THEN 1 WHEN x BETWEEN 3 AND 5 THEN 2 WHEN x > 5 THEN x - 3 WHEN x > 2 THEN x - 1 ELSE x END AS t FROM a),
        {at_sql("mv", "track_km", "mo", "tk")}, {at_sql("mv", "smoothed_m", "mo", "te")}
        SELECT mo.route_id, mo.k, paused, round(tk.v, 4) + 0.0 AS track_km, round(te.v, 4) + 0.0 AS elevation_m FROM mo JOIN tk ON tk.route_id = mo.route_id AND tk.k = mo.k JOIN te ON te.route_id = mo.route_id AND te.k = mo.k""",
    "downsampled_profiles": f"""WITH RECURSIVE {PROFILE_SQL}, v AS (SELECT route_id, k, round(smoothed_m, 4) AS e, row_number() OVER (PARTITION BY route_id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY route_id) AS n FROM profile WHERE smoothed_m IS NOT NULL),
        p AS (SELECT route_id, k, e, 0 AS b, n FROM v WHERE i = 0 AND n > 12 UNION ALL
            SELECT route_id, k, e, b, n FROM (SELECT v.route_id, v.k, v.e, p.b + 1 AS b, v.n, row_number() OVER (PARTITION BY v.route_id ORDER BY abs(v.e - p.e) DESC, v.i) AS z
                FROM p JOIN v ON v.route_id = p.route_id AND v.i >= floor(1 + p.b * ((v.n - 2) / 10.0::DOUBLE)) AND v.i < greatest(floor(1 + p.b * ((v.n - 2) / 10.0::DOUBLE)) + 1, floor(1 + (p.b + 1) * ((v.n - 2) / 10.0::DOUBLE)))
                WHERE p.b < 10) WHERE z = 1)
        SELECT route_id, k FROM p UNION ALL SELECT route_id, k FROM v WHERE n > 12 AND i = n - 1 UNION ALL SELECT route_id, k FROM v WHERE n <= 12""",
    "calendar_issues": """WITH d AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS f, CAST(o_orderkey % 9 AS INT) AS i FROM orders)
        SELECT CAST(k AS VARCHAR) AS id, 'date-mismatch' AS code FROM d WHERE CASE WHEN k % 60 = 1 THEN k % 120 <> 1 ELSE k % 40 = 0 END""",
}
DOCUMENTED_SQL = """pt AS (SELECT l_orderkey AS trip_id, l_partkey AS point_id, ['matched', 'needs-review', 'unmatched'][l_suppkey % 3 + 1] AS status, CASE WHEN l_linenumber = 1 THEN 'pause' ELSE 'poi' END AS kind FROM lineitem WHERE l_partkey % 13 <> 0
        OR l_partkey NOT IN (SELECT p_partkey FROM part)),
    rs AS (SELECT pt.*, p_partkey IS NOT NULL AS listed, CASE WHEN p_partkey IS NOT NULL THEN CASE WHEN point_id % 2 = 0 THEN 'excluded' ELSE 'informational' END WHEN status = 'matched' THEN 'matched' ELSE 'user-decision-required' END AS resolution
        FROM pt LEFT JOIN part ON p_partkey = point_id AND point_id % 11 = 0)"""
SQL |= {
    "resolved_points": f"""WITH {DOCUMENTED_SQL} SELECT status, resolution, CASE WHEN listed THEN 'said so' END AS justification, count(*) AS points, count(*) FILTER (listed AND point_id % 3 = 0) AS shown FROM rs GROUP BY ALL""",
    "match_summaries": f"""WITH {DOCUMENTED_SQL}, d AS (SELECT o_orderkey AS trip_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'off' ELSE 'ride' END AS kind, o_orderstatus = 'F' AS ready FROM orders),
        a AS (SELECT trip_id, count(*) AS days, count(*) FILTER (kind = 'ride') AS rides, count(*) FILTER (kind = 'off') AS offs, count(*) FILTER (kind = 'ride' AND ready) AS ready, count(*) FILTER (kind = 'ride' AND NOT ready) AS unavailable FROM d GROUP BY 1),
        b AS (SELECT trip_id, count(*) AS points, count(*) FILTER (status = 'matched') AS status_matched, count(*) FILTER (status = 'needs-review') AS status_needs_review, count(*) FILTER (status = 'unmatched') AS status_unmatched,
            count(*) FILTER (resolution = 'matched') AS resolution_matched, count(*) FILTER (resolution = 'informational') AS resolution_informational, count(*) FILTER (resolution = 'excluded') AS resolution_excluded,
            count(*) FILTER (resolution = 'user-decision-required') AS resolution_user_decision_required, count(*) FILTER (kind = 'pause' AND status = 'matched') AS matched_pauses,
            count(*) FILTER (status = 'matched' AND point_id % 2 = 0) AS links FROM rs GROUP BY 1)
        SELECT a.*, coalesce(points, 0) AS points, coalesce(status_matched, 0) AS status_matched, coalesce(status_needs_review, 0) AS status_needs_review, coalesce(status_unmatched, 0) AS status_unmatched,
            coalesce(resolution_matched, 0) AS resolution_matched, coalesce(resolution_informational, 0) AS resolution_informational, coalesce(resolution_excluded, 0) AS resolution_excluded,
            coalesce(resolution_user_decision_required, 0) AS resolution_user_decision_required, coalesce(matched_pauses, 0) AS matched_pauses, coalesce(links, 0) AS links FROM a LEFT JOIN b USING (trip_id)""",
}
