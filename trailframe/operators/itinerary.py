"""The waypoints of a stage, from its ends, places and climbs to pauses and times of arrival.

What belongs to one stage meets in one row: its few places and climbs are arrays
(bounded by what lies along one route), and the choices that depend on each other
(which climb takes a landmark, which pause a place) are folds over them.  The
track itself is never gathered; coordinates, heights and moving times come from
one sort by route each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions.clock import clock, clock_text, parse_clock
from trailframe.functions.terrain import climb_importance, waypoint_visible
from trailframe.operators.stages import ANCHORS, ORDER, placing, ranks
from trailframe.operators.terrain import EPSILON, display_profile, interpolate, timing
from trailframe.operators.trip import PAUSE_RULES
from trailframe.operators.waypoints import name_key

#: Kinds of places that become waypoints, and how near a climb's top its landmark is, an end a place of its name. Fixed values.
SURFACED, LOCALITIES, LANDMARKS = ("city", "town", "village", "mountain-pass", "saddle"), ("city", "town", "village"), ("mountain-pass", "saddle")
MERGE_KM, ENDPOINT_KM = 1.0, 2.0
#: Names of what has none. Fixed values.
START, END, CLIMB = "Départ", "Arrivée", "Montée"
#: A waypoint in a row's array; arrays of these sort as waypoints are ordered.
FIELDS = ("km", "rank", "waypoint_id", "kind", "importance", "name", "latitude", "longitude", "elevation_m", "climb_id")


def quoted(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def waypoint(**fields: str) -> str:
    """SQL: a waypoint; fields that aren't given are null."""
    types = dict(km="double", rank="int", latitude="double", longitude="double", elevation_m="double", climb_id="bigint")
    return "named_struct(" + ", ".join(f"'{f}', cast({fields.get(f, 'null')} as {types.get(f, 'string')})" for f in FIELDS) + ")"


def listed(rows: DataFrame, name: str, *columns: Column | str) -> DataFrame:
    return rows.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def stage_rows(stages: DataFrame, series: DataFrame, points: DataFrame, climbs: DataFrame, mountains: Column | None = None) -> DataFrame:
    """Stages with total_km and ws, the array of their waypoints in order; stages without a series are gone.

    A climb takes the landmark of its name near its top and is then that landmark's
    waypoint, each landmark once, in order of the tops; localities that repeat the name
    of an end near it are left out.
    """
    row, order = F.struct("distance_km", "latitude", "longitude", "elevation_m"), F.struct("distance_km", "seq")
    ends = series.groupBy("route_id").agg(F.min_by(row, order).alias("_first"), F.max_by(row, order).alias("_last"))
    places = points.where(F.col("kind").isin(*SURFACED) & F.col("track_km").isNotNull()).withColumn("key", name_key(F.col("name")))
    marks = listed(places, "_marks", F.col("track_km").alias("km"), ranks(F.col("kind"), ORDER).alias("rank"), F.col("point_id").alias("pid"), "kind", "name", "key", "latitude", "longitude", "elevation_m")
    size = [F.col("end_km") - F.col("start_km"), F.col("gain_m"), F.col("average_grade"), F.col("confirmed") & F.col("name").isNotNull()]
    large = climb_importance(*size, False) if mountains is None else F.when(mountains, climb_importance(*size, True)).otherwise(climb_importance(*size, False))
    tops = listed(climbs.withColumn("key", name_key(F.col("name"))), "_tops", F.col("end_km").alias("km"), F.col("climb_id").alias("cid"), "name", "key", large.alias("importance"), F.col("end_m").alias("elevation_m"))
    rows = stages.join(ends, "route_id").join(marks, "route_id", "left").join(tops, "route_id", "left").withColumn("total_km", F.col("_last.distance_km"))
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("_marks", "_tops")}).withColumns({"_sk": name_key(F.col("start_name")), "_ek": name_key(F.col("end_name"))})

    free = f"filter(_marks, m -> m.kind in {quoted(LANDMARKS)} and m.key = c.key and abs(m.km - c.km) <= {MERGE_KM}D and not exists(acc, q -> q.pid = m.pid))"
    best = f"array_min(transform({free}, m -> named_struct('p', if(m.kind = 'mountain-pass', 0, 1), 'far', abs(m.km - c.km), 'pid', m.pid)))"
    pair = f"filter(transform(array({best}), b -> named_struct('pid', b.pid, 'cid', c.cid)), b -> b.pid is not null)"
    ids = (dict(points.dtypes)["point_id"], dict(climbs.dtypes)["climb_id"])
    rows = rows.withColumn("_met", F.expr(f"aggregate(_tops, cast(array() as array<struct<pid:{ids[0]},cid:{ids[1]}>>), (acc, c) -> concat(acc, {pair}))"))
    again = f"coalesce(m.key = _sk and m.km <= {ENDPOINT_KM}D or m.key = _ek and m.km >= total_km - {ENDPOINT_KM}D, false)"
    side = lambda kind, name, km, at: waypoint(km=km, rank=str(ORDER[kind]), waypoint_id=f"'{kind}'", kind=f"'{kind}'", importance="'major'", name=f"coalesce({kind}_name, '{name}')", **{c: f"{at}.{c}" for c in ("latitude", "longitude", "elevation_m")})
    spot = waypoint(
        km="m.km", rank="m.rank", waypoint_id="concat('place-', cast(m.pid as string))", kind="m.kind", importance="if(m.kind = 'village', 'secondary', 'major')", name="m.name", latitude="m.latitude", longitude="m.longitude",
        elevation_m="m.elevation_m", climb_id="get(filter(_met, q -> q.pid = m.pid), 0).cid",
    )
    bare = waypoint(km="c.km", rank=str(ORDER["climb"]), waypoint_id="concat('climb-', cast(c.cid as string))", kind="'climb'", importance="c.importance", name=f"coalesce(c.name, '{CLIMB}')", elevation_m="c.elevation_m", climb_id="c.cid")
    whole = (
        f"array_sort(concat(array({side('start', START, '0', '_first')}, {side('end', END, 'total_km', '_last')}), "
        f"transform(filter(_marks, m -> not (m.kind in {quoted(LOCALITIES)} and {again})), m -> {spot}), transform(filter(_tops, c -> not exists(_met, q -> q.cid = c.cid)), c -> {bare})))"
    )
    return rows.withColumn("ws", F.expr(whole)).select(*stages.columns, "total_km", "ws")


def located(rows: DataFrame, series: DataFrame, *more: str) -> DataFrame:
    """Waypoints of the arrays `ws` as rows: position, coordinates and heights filled in from the route; the height of an end is its own or none."""
    carried = [c for c in more if c in rows.columns]
    flat = rows.select("route_id", *carried, F.posexplode("ws").alias("_i", "_w")).select("route_id", *carried, (F.col("_i") + 1).alias("k"), F.col("_w.km").alias("target_km"), "_w")
    at = interpolate(series, flat, ("latitude", "longitude", "elevation_m"), keep=("_w", *carried))
    filled = lambda c: F.coalesce(f"_w.{c}", c)
    height = F.when(F.col("_w.kind").isin("start", "end"), F.col("_w.elevation_m")).otherwise(filled("elevation_m"))
    plain = [F.col(f"_w.{c}").alias(c) for c in ("waypoint_id", "kind", "importance", "name", "km", "climb_id")]
    extra = [c if c in carried else F.col(f"_w.{c}").alias(c) for c in more]
    return at.select("route_id", F.col("k").alias("position"), *plain, filled("latitude").alias("latitude"), filled("longitude").alias("longitude"), height.alias("elevation_m"), *extra)


def canonical_waypoints(stages: DataFrame, series: DataFrame, points: DataFrame, climbs: DataFrame, mountains: Column | None = None) -> DataFrame:
    """The waypoints of every stage in order (by distance, kind, id), without pauses.

    stages: route_id, start_name, end_name; series: route_id, seq, distance_km,
    latitude, longitude, elevation_m; points: route_id, point_id, kind, name, track_km,
    latitude, longitude, elevation_m; climbs: route_id, climb_id, name, start_km,
    end_km, gain_m, average_grade, end_m, confirmed (its name comes from a map).
    mountains: a condition on climbs, whose importance is then judged more strictly.
    """
    return located(stage_rows(stages, series, points, climbs, mountains), series)


def with_stage_pauses(rows: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """Add ps, the pauses (km, minutes, waypoint_id, name) of each stage.

    rows: route_id, total_km, ws, pause_minutes, mode.  Stages of mode custom have their own
    pauses (route_id, waypoint_id, minutes) at waypoints that exist, the others the automatic
    ones (whole minutes, the spare ones to the largest fractions) at the best places.
    """
    rules = "array(" + ", ".join(f"named_struct('name', '{n}', 'at', {at}D, 'part', {part}D)" for n, at, part in PAUSE_RULES) + ")"
    rest = lambda x: f"({x}.ex - floor({x}.ex))"
    before = f"size(filter(_parts, (q, j) -> {rest('q')} > {rest('x')} or ({rest('q')} = {rest('x')} and j < i)))"
    minutes = f"cast(floor(x.ex) + if({before} < pause_minutes - aggregate(_parts, 0D, (a, q) -> a + floor(q.ex)), 1, 0) as bigint)"
    anchor = "case w.kind " + " ".join(f"when '{k}' then {p}" for k, p in ANCHORS.items()) + " end"
    rows = rows.withColumn("_parts", F.expr(f"if(coalesce(mode, '') <> 'custom' and pause_minutes > 0 and total_km > 0, transform({rules}, r -> named_struct('name', r.name, 'km', total_km * r.at, 'ex', pause_minutes * r.part)), array())"))
    rows = rows.withColumn("_is", F.expr(f"filter(transform(_parts, (x, i) -> named_struct('position', i, 'km', x.km, 'minutes', {minutes})), x -> x.minutes > 0)"))
    rows = rows.withColumn("_as", F.expr(f"transform(filter(ws, w -> w.kind in {quoted(tuple(ANCHORS))}), w -> named_struct('p', {anchor}, 'km', w.km, 'id', w.waypoint_id))"))
    rows = rows.withColumn("_placed", F.expr(placing("_is", "_as", "total_km", "int", "bigint", "string")))
    own = "cast(array() as array<struct<km:double,minutes:bigint,waypoint_id:string,name:string>>)"
    if custom is not None:
        rows = rows.join(listed(custom, "_own", "waypoint_id", F.col("minutes").cast("long").alias("minutes")), "route_id", "left")
        there = "transform(_own, o -> named_struct('w', get(filter(ws, w -> w.waypoint_id = o.waypoint_id), 0), 'minutes', o.minutes))"
        own = f"if(mode = 'custom' and _own is not null, transform(filter({there}, x -> x.w is not null), x -> named_struct('km', x.w.km, 'minutes', x.minutes, 'waypoint_id', x.w.waypoint_id, 'name', x.w.name)), {own})"
    kept = [c for c in rows.columns if not c.startswith("_")]
    ps = f"concat(transform(_placed, x -> named_struct('km', x.km, 'minutes', x.minutes, 'waypoint_id', x.waypoint_id, 'name', {rules}[x.position].name)), {own})"
    return rows.select(*kept, F.expr(ps).alias("ps"))


def stage_waypoints(stages: DataFrame, series: DataFrame, points: DataFrame, climbs: DataFrame, custom: DataFrame | None = None, reference_kph: float = 18.0, mountains: Column | None = None) -> DataFrame:
    """Canonical waypoints with pauses, elapsed minutes, clock and whether they show by default.

    Besides what canonical_waypoints reads, stages have pause_minutes, mode (custom or
    not) and departure (HH:MM).  Several pauses at one waypoint are shown as their sum;
    a pause delays what lies behind it, not its own place.
    Routes without length have waypoints, but no times.
    """
    rows = with_stage_pauses(stage_rows(stages, series, points, climbs, mountains), custom)
    fields = ", ".join(f"'{f}', w.{f}" for f in FIELDS)
    mine = "filter(ps, q -> q.waypoint_id = w.waypoint_id)"
    here = f"if(size({mine}) > 0, aggregate({mine}, 0L, (a, q) -> a + q.minutes), cast(null as bigint))"
    alone = waypoint(km="q.km", rank=str(ORDER["pause"]), waypoint_id="concat('pause-', q.name)", kind="'pause'", importance="'minor'", name="q.name")
    bare = alone[:-1] + ", 'pause_minutes', q.minutes)"
    rows = rows.withColumn("ws", F.expr(f"array_sort(concat(transform(ws, w -> named_struct({fields}, 'pause_minutes', {here})), transform(filter(ps, q -> q.waypoint_id is null), q -> {bare})))"))
    late = f"transform(ws, w -> struct(w.*, aggregate(filter(ps, q -> q.km + {EPSILON:.9f}D <= w.km), 0L, (a, q) -> a + q.minutes) as paused_minutes))"
    late = late.replace("w.*", ", ".join(f"w.{f} as {f}" for f in (*FIELDS, "pause_minutes")))
    rows = rows.select("route_id", F.expr(late).alias("ws"), parse_clock(F.col("departure")).alias("_from"))
    placed = located(rows, series, "pause_minutes", "paused_minutes", "_from")

    timed = timing(display_profile(series.select("route_id", "distance_km", "latitude", "longitude", "elevation_m")), reference_kph)
    own = tuple(c for c in placed.columns if c not in ("route_id", "position"))
    moved = interpolate(timed.select("route_id", "distance_km", "moving_minutes"), placed.select("*", F.col("position").alias("k"), F.col("km").alias("target_km")), ("moving_minutes",), keep=own)
    moved = moved.withColumn("elapsed_minutes", F.col("moving_minutes") + F.col("paused_minutes"))
    at = clock(F.col("_from"), F.col("elapsed_minutes"))
    visible = waypoint_visible(F.col("kind"), F.col("importance"), F.col("pause_minutes").isNotNull())
    shown = [c for c in own if c not in ("paused_minutes", "_from")]
    return moved.select("route_id", F.col("k").alias("position"), *shown, "moving_minutes", "elapsed_minutes", clock_text(at["clock_minutes"], at["day_offset"]).alias("clock_time"), visible.alias("visible"))
