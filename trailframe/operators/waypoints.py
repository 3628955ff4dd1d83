"""Names, landmarks, waypoints and files of a trip: joins where order doesn't matter, grouped folds where it does.

Every fold sees one group (a trip's files, the places of a cluster of a day's
points, a route's climbs), never a table.
"""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trailframe.functions.geo import EARTH_KM, EARTH_M, equirectangular_m, haversine_km
from trailframe.operators.spatial import cells


@F.pandas_udf(StringType())
def without_marks(names: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, in lower case: Spark has no such function."""
    return names.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not 0x300 <= ord(c) <= 0x36F).lower())


def name_key(name: Column) -> Column:
    """Letters a-z and digits alone, null if none is left: the key under which names of places meet."""
    return F.nullif(F.regexp_replace(without_marks(name), "[^a-z0-9]+", ""), F.lit(""))


def name_words(name: Column) -> Column:
    """The same with blanks between words, for names that are compared as phrases."""
    return F.trim(F.regexp_replace(without_marks(name), "[^a-z0-9]+", " "))


def column_key(name: Column) -> Column:
    """Letters a-z and digits with single hyphens between, under which pictures of passes are found."""
    return F.regexp_replace(F.regexp_replace(without_marks(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def climb_landmarks(climbs: DataFrame, landmarks: DataFrame, within_km: float = 1.0) -> DataFrame:
    """The named landmark of each climb's top: passes before others, then the nearest along the track, then the smaller id.

    Of passes and of others, only the last one up to a top and the first one from it
    on can be the nearest, so places of tops and landmarks are merged by one sort per
    route each way; no pair is made.  What stands at one place counts once.
    """
    at = F.col("track_km").cast("double").alias("_at")
    passing = F.col("kind").eqNullSafe("mountain-pass")
    marks = landmarks.where("name is not null and track_km is not null").select("route_id", at, passing.alias("_pass"), F.struct("landmark_id", "name").alias("_m"))
    marks = marks.groupBy("route_id", "_at").agg(*[F.min(F.when(F.col("_pass") == (p == 0), F.struct("_at", "_m"))).alias(f"_{p}") for p in (0, 1)], F.lit(0).alias("_top"))
    tops = climbs.where("end_km is not null").select("route_id", F.col("end_km").cast("double").alias("_at")).distinct()
    nothing = [F.lit(None).cast(marks.schema[f"_{p}"].dataType).alias(f"_{p}") for p in (0, 1)]
    merged = marks.union(tops.select("route_id", "_at", *nothing, F.lit(1)))
    seen = []
    for side, order in (("before", F.asc("_at")), ("after", F.desc("_at"))):
        w = Window.partitionBy("route_id").orderBy(order, "_top").rowsBetween(Window.unboundedPreceding, 0)
        for p in (0, 1):
            merged = merged.withColumn(f"_{side}{p}", F.last(f"_{p}", ignorenulls=True).over(w))
            m = F.col(f"_{side}{p}")
            seen.append(F.struct(F.lit(p).alias("p"), F.abs(m["_at"] - F.col("_at")).alias("far"), m["_m"].alias("m")))
    best = F.array_min(F.filter(F.array(*seen), lambda x: x["far"] <= within_km))
    found = merged.where("_top = 1").select("route_id", "_at", best.alias("b")).where("b is not null")
    asked = climbs.select("route_id", "climb_id", F.col("end_km").cast("double").alias("_at")).join(found, ["route_id", "_at"])
    return asked.groupBy("route_id", "climb_id").agg(F.min("b").alias("b")).select("route_id", "climb_id", "b.m.landmark_id", "b.m.name")


def merged_climbs(climbs: DataFrame, landmarks: DataFrame, within_km: float = 1.0) -> DataFrame:
    """One-to-one: climbs by their top take the best free landmark of the same name; climb_id, landmark_id (or null).

    A landmark that is taken is gone for later climbs, so a route and name is folded in order.
    """
    a = climbs.select("route_id", name_key(F.col("name")).alias("key"), F.col("climb_id").alias("id"), F.col("end_km").alias("km"), F.lit(0).alias("kind"))
    b = landmarks.select("route_id", name_key(F.col("name")).alias("key"), F.col("landmark_id").alias("id"), F.col("track_km").alias("km"), F.when(F.col("kind") == "mountain-pass", 1).otherwise(2).alias("kind"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        free = rows[rows.kind > 0].copy()
        out = []
        for climb in rows[rows.kind == 0].sort_values(["km", "id"]).itertuples():
            near = free[(free.km - climb.km).abs() <= within_km]
            if climb.key is None or near.empty:
                out.append((climb.route_id, climb.id, None))
                continue
            pick = near.assign(far=(near.km - climb.km).abs()).sort_values(["kind", "far", "id"]).iloc[0]
            free = free[free.id != pick.id]
            out.append((climb.route_id, climb.id, pick.id))
        return pd.DataFrame(out, columns=["route_id", "climb_id", "landmark_id"]).astype({"landmark_id": "Int64"})

    return a.union(b).groupBy("route_id", "key").applyInPandas(fold, "route_id long, climb_id long, landmark_id long")


def distinct_climbs(climbs: DataFrame) -> DataFrame:
    """Climbs that cover each other (0.8 of the shorter, tops within 0.25 km for one anchor, 0.1 km else): one set by hand stays, else the one with more gain."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for c in rows.sort_values("ordinal").itertuples():
            for i, k in enumerate(kept):
                short = min(k.end_km - k.start_km, c.end_km - c.start_km)
                gap = abs(k.end_km - c.end_km)
                anchored = k.anchor is not None and k.anchor == c.anchor
                if short > 0 and (min(k.end_km, c.end_km) - max(k.start_km, c.start_km)) / short >= 0.8 and gap <= (0.25 if anchored else 0.1):
                    if (c.manual, c.gain_m) > (k.manual, k.gain_m):
                        kept[i] = c
                    break
            else:
                kept.append(c)
        return rows.loc[[k.Index for k in kept]]

    return climbs.groupBy("route_id").applyInPandas(fold, climbs.schema)


def with_islands(rows: DataFrame, keys: list[str], value: Column, size: float, name: str) -> DataFrame:
    """Add `name`: the number of the island of `value` within the keys; values of different islands are more than `size` apart."""
    order = Window.partitionBy(*keys).orderBy("_cell")
    begins = F.coalesce(F.col("_cell") - F.lag("_cell").over(order) > 1, F.lit(False)).cast("long")
    return rows.withColumn("_cell", F.floor(value / size)).withColumn("_new", begins).withColumn(name, F.sum("_new").over(order)).drop("_cell", "_new")


def linked_groups(rows: pd.DataFrame | dict, within_m: float, within_up_m: float) -> list[int]:
    """The group of each row, taken in their order: the first group whose members are all near it, else a new one.

    A group spans less than the reach, so one that fits has its first member in a neighbouring cell; of its heights the ends are enough.
    """
    lat, lon, up = (np.asarray(rows[c], float) for c in ("latitude", "longitude", "elevation_m"))
    metres = 1000 * EARTH_KM * np.pi / 180
    most = np.abs(lat).max(initial=0)
    wide = within_m * 1.001 / (metres * np.cos(np.radians(most))) if most < 80 and np.abs(lon).max(initial=0) < 179 else 400.0
    keys = zip(*(np.floor(v / w).astype(int).tolist() for v, w in ((lat, within_m * 1.001 / metres), (lon, wide), (up, within_up_m * 1.001))), strict=True)
    groups: list[list] = []  # places, lowest, highest
    cells_: dict[tuple[int, int, int], list[int]] = {}
    where = []
    for (r, c, h), y, x, e in zip(keys, np.radians(lat).tolist(), np.radians(lon).tolist(), up.tolist(), strict=True):

        def near(place: tuple[float, float], y: float = y, x: float = x) -> bool:
            half = math.sin((place[0] - y) / 2) ** 2 + math.cos(place[0]) * math.cos(y) * math.sin((place[1] - x) / 2) ** 2
            return 2000 * EARTH_KM * math.asin(math.sqrt(min(1.0, half))) < within_m

        around = sorted(g for i in (r - 1, r, r + 1) for j in (c - 1, c, c + 1) for k in (h - 1, h, h + 1) for g in cells_.get((i, j, k), ()))
        home = next((g for g in around if e - groups[g][1] < within_up_m and groups[g][2] - e < within_up_m and all(map(near, groups[g][0]))), len(groups))
        if home == len(groups):
            groups.append([set(), e, e])
            cells_.setdefault((r, c, h), []).append(home)
        group = groups[home]
        group[0].add((y, x))
        group[1], group[2] = min(group[1], e), max(group[2], e)
        where.append(home)
    return where


def grouped_points(points: DataFrame, within_m: float = 100.0, within_up_m: float = 30.0) -> DataFrame:
    """Points of a day in groups whose members are all near each other (complete linkage, in track order): day_id, point_id, group.

    Points at one place always share a group, so the fold sees places; it sees one
    cluster of a day, as points of different islands of latitude, height or
    longitude are never near.  A point without a place is a group of its own.
    """
    place = ["latitude", "longitude", "elevation_m"]
    points = points.select("day_id", "point_id", "track_km", *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in place])
    placed = F.lit(True)
    for c in place:
        placed = placed & F.col(c).isNotNull()
    order = F.struct(F.col("track_km").isNull().alias("last"), "track_km", "point_id")
    spots = points.where(placed).groupBy("day_id", *place).agg(F.min(order).alias("at"))
    metres = 1000 * EARTH_KM * np.pi / 180
    spots = with_islands(spots, ["day_id"], F.col("latitude") * metres, within_m * 1.001, "_a")
    spots = with_islands(spots, ["day_id", "_a"], F.col("elevation_m"), within_up_m * 1.001, "_b")
    # a degree of longitude is never shorter than at 80 degrees; where that or the date line is passed, the axis isn't cut
    cut = F.min((F.abs("latitude") < 80) & (F.abs("longitude") < 179)).over(Window.partitionBy("day_id", "_a", "_b"))
    east = F.when(cut, F.col("longitude") * (metres * math.cos(math.radians(80)))).otherwise(0.0)
    spots = with_islands(spots.withColumn("_east", east), ["day_id", "_a", "_b"], F.col("_east"), within_m * 1.001, "_c")

    @F.pandas_udf("array<int>")
    def firsts(lat: pd.Series, lon: pd.Series, up: pd.Series) -> pd.Series:
        """For each place of a cluster, in track order, where its group's first one stands; a batch holds many clusters."""

        def of(places: tuple) -> np.ndarray:
            group = linked_groups(dict(zip(place, places, strict=True)), within_m, within_up_m)
            return np.unique(group, return_index=True)[1][group].astype(np.int32)

        return pd.Series([of(places) for places in zip(lat, lon, up, strict=True)])

    cluster = F.concat_ws(".", "_a", "_b", "_c").alias("cluster")
    island = ["day_id", "_a", "_b", "_c"]
    sized = spots.withColumn("_n", F.count("*").over(Window.partitionBy(*island))).select(*island, "_n", *place, cluster, "at.*")
    # a cluster of one place is a group as it stands; only the others are folded
    many = sized.where("_n > 1").groupBy(*island, "cluster").agg(F.array_sort(F.collect_list(F.struct("last", "track_km", "point_id", *place))).alias("_rows"))
    many = many.withColumn("_first", firsts(*[F.col(f"_rows.{c}") for c in place]))
    member = "transform(_rows, (r, i) -> named_struct('r', r, 'f', _rows[_first[i]]))"
    folded = many.select("day_id", "cluster", F.explode(F.expr(member)).alias("m")).select("day_id", *[F.col(f"m.r.{c}") for c in place], "cluster", "m.f.last", "m.f.track_km", "m.f.point_id")
    folded = folded.union(sized.where("_n = 1").select("day_id", *place, "cluster", "last", "track_km", "point_id"))
    alone = points.where(~placed).select("day_id", *[F.lit(None).cast("double").alias(c) for c in place], F.lit(None).cast("string").alias("cluster"), "track_km", "point_id", order.alias("at"))
    begun = folded.select("day_id", *place, "cluster", "track_km", "point_id", order.alias("at")).union(alone)
    number = F.dense_rank().over(Window.partitionBy("day_id").orderBy("at", "cluster")) - 1
    numbered = begun.withColumn("group", number.cast("int"))
    groups = numbered.where("cluster is not null").select("day_id", *place, "group")
    together = points.join(groups, ["day_id", *place]).select("day_id", "point_id", "group")
    return together.union(numbered.where("cluster is null").select("day_id", "point_id", "group"))


def simplified(points: DataFrame, most: int = 100) -> DataFrame:
    """At most so many points of a route: the one farthest from the line so far is added again and again."""

    def lateral(lat: np.ndarray, lon: np.ndarray, a: int, b: int) -> np.ndarray:
        mid, scale = slice(a + 1, b), EARTH_M * np.pi / 180
        x = np.cos(np.radians((lat[a] + lat[b] + lat[mid]) / 3)) * scale
        ex, ey, px, py = (lon[b] - lon[a]) * x, (lat[b] - lat[a]) * scale, (lon[mid] - lon[a]) * x, (lat[mid] - lat[a]) * scale
        square = ex**2 + ey**2
        t = np.where(square > 0, np.clip((px * ex + py * ey) / np.where(square > 0, square, 1), 0, 1), 0)
        return np.hypot(px - t * ex, py - t * ey)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        import heapq

        ordered = rows.sort_values("seq")
        lat, lon = (ordered[c].to_numpy(float) for c in ("latitude", "longitude"))
        if len(ordered) <= most:
            return ordered
        heap: list[tuple[float, int, int, int, int]] = []

        def push(a: int, b: int, order: int) -> None:
            if b > a + 1:
                d = lateral(lat, lon, a, b)
                if d.max() > 0:
                    heapq.heappush(heap, (-float(d.max()), order, a, int(d.argmax()) + a + 1, b))

        kept = {0, len(ordered) - 1}
        push(0, len(ordered) - 1, 0)
        while heap and len(kept) < max(2, most):
            _, order, a, split, b = heapq.heappop(heap)
            kept.add(split)
            push(a, split, 2 * order + 1)
            push(split, b, 2 * order + 2)
        return ordered.iloc[sorted(kept)]

    return points.groupBy("route_id").applyInPandas(fold, points.schema)


def file_order(files: DataFrame, loop_km: float = 2.0) -> DataFrame:
    """The order of a trip's files: by their numbers if all have distinct ones, else the shortest greedy chain over all first files.

    files: trip_id, file_name, number, lat1, lon1, lat2, lon2 -> trip_id, file_name, position, method, is_loop.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        f = rows.sort_values("file_name").reset_index(drop=True)
        n = len(f)
        start, end = np.radians(f[["lat1", "lon1"]].to_numpy(float)), np.radians(f[["lat2", "lon2"]].to_numpy(float))
        half = np.sin((start[None] - end[:, None]) / 2) ** 2
        gap = 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(half[..., 0] + np.cos(end[:, None, 0]) * np.cos(start[None, :, 0]) * half[..., 1], 0, 1)))
        if n > 1 and f["number"].notna().all() and f["number"].is_unique:
            order, method = list(np.argsort(f["number"].to_numpy(float), kind="stable")), "number"
        else:
            method, best = ("single" if n == 1 else "place"), np.inf
            order = list(range(n))
            for first in range(n if n > 1 else 0):
                chain, left, total = [first], [i for i in range(n) if i != first], 0.0
                while left:
                    nearest = min(left, key=lambda i: gap[chain[-1], i])
                    total += gap[chain[-1], nearest]
                    chain.append(nearest)
                    left.remove(nearest)
                if total < best:
                    best, order = total, chain
        loop = n > 1 and gap[order[-1], order[0]] <= loop_km
        return pd.DataFrame({"trip_id": f["trip_id"], "file_name": f["file_name"].to_numpy()[order], "position": range(n), "method": method, "is_loop": bool(loop)})

    return files.groupBy("trip_id").applyInPandas(fold, "trip_id long, file_name string, position int, method string, is_loop boolean")


def rotated(order: DataFrame, first: DataFrame) -> DataFrame:
    """A loop's files from a chosen first one on, in the direction with the smaller sum of gaps (as they are, where both are equal).

    order: trip_id, file_name, position, lat1, lon1, lat2, lon2 (start and end); first: trip_id, file_name.
    The gaps of the whole cycle are summed once for each direction; a rotation lacks
    the one gap into its first file, so every rotation is known from two sums and
    two gaps.  Without a choice, or with an unknown file, a trip keeps its order.
    """
    whole = Window.partitionBy("trip_id")
    w = whole.orderBy("position")
    place = F.struct("lat1", "lon1", "lat2", "lon2")
    rows = order.withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(whole))
    rows = rows.withColumn("_next", F.coalesce(F.lead(place).over(w), F.first(place).over(w)))
    ahead = haversine_km(F.col("lat2"), F.col("lon2"), F.col("_next.lat1"), F.col("_next.lon1"))
    back = haversine_km(F.col("_next.lat2"), F.col("_next.lon2"), F.col("lat1"), F.col("lon1"))
    rows = rows.withColumn("_ahead", ahead).withColumn("_back", back)
    chosen = first.select("trip_id", F.col("file_name").alias("_first")).dropDuplicates(["trip_id"])
    rows = rows.join(chosen, "trip_id", "left")
    start = F.max(F.when(F.col("file_name") == F.col("_first"), F.col("_k"))).over(whole)
    rows = rows.withColumn("_p", start)
    into = F.max(F.when(F.pmod(F.col("_k") + 1, F.col("_n")) == F.col("_p"), F.col("_ahead"))).over(whole)
    out = F.max(F.when(F.col("_k") == F.col("_p"), F.col("_back"))).over(whole)
    turn = F.coalesce(F.sum("_back").over(whole) - out < F.sum("_ahead").over(whole) - into, F.lit(False))
    rows = rows.withColumn("_turn", turn)
    at = F.when(F.col("_turn"), F.pmod(F.col("_p") - F.col("_k"), F.col("_n"))).otherwise(F.pmod(F.col("_k") - F.coalesce("_p", F.lit(0)), F.col("_n")))
    return rows.select("trip_id", "file_name", at.cast("int").alias("position"), F.when(F.col("_turn"), "backward").otherwise("forward").alias("direction"))


def aligned(documented: DataFrame, detected: DataFrame, within_m: float = 150.0) -> DataFrame:
    """Order-preserving alignment of documented passes to detected summits of a day: most matches, then the least height error.

    day_id, ordinal (documented), seq (detected) of the matched pairs.
    """
    a = documented.select("day_id", F.lit(0).alias("side"), F.col("ordinal").alias("k"), F.col("elevation_m").cast("double").alias("e"))
    b = detected.select("day_id", F.lit(1).alias("side"), F.col("seq").alias("k"), F.col("elevation_m").cast("double").alias("e"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = (rows[rows.side == s].sort_values("k") for s in (0, 1))
        xe, ye = x.e.to_numpy(), y.e.to_numpy()
        best = [[(0, 0.0)] * (len(ye) + 1) for _ in range(len(xe) + 1)]  # matches, less error; later rows first
        for i in range(len(xe) - 1, -1, -1):
            for j in range(len(ye) - 1, -1, -1):
                best[i][j] = max(best[i + 1][j], best[i][j + 1])
                error = abs(xe[i] - ye[j])
                if error <= within_m:
                    m, less = best[i + 1][j + 1]
                    best[i][j] = max(best[i][j], (m + 1, less - error))
        i = j = 0
        out = []
        while i < len(xe) and j < len(ye):
            error = abs(xe[i] - ye[j])
            m, less = best[i + 1][j + 1]
            if error <= within_m and best[i][j] == (m + 1, less - error):
                out.append((rows.day_id.iloc[0], int(x.k.iloc[i]), int(y.k.iloc[j])))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
        return pd.DataFrame(out, columns=["day_id", "ordinal", "seq"])

    return a.union(b).groupBy("day_id").applyInPandas(fold, "day_id long, ordinal long, seq long")


def with_slots(slots: DataFrame) -> DataFrame:
    """Number the days of a trip from its slots (ride, off, transfer): the index of all, the number of the rides."""
    w = Window.partitionBy("trip_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return slots.withColumn("index", F.count("*").over(w) - 1).withColumn("ride_number", F.when(F.col("kind") == "ride", F.count_if(F.col("kind") == "ride").over(w)))


#: Reach (metres) and greatest difference of elevation of what may name a summit; fixed values.
NAMING = {"mountain-pass": (250.0, 120.0), "saddle": (300.0, 120.0), "peak": (75.0, 60.0)}
PEAK_WITHOUT_ELEVATION_M = 40.0


def summit_names(summits: DataFrame, candidates: DataFrame) -> DataFrame:
    """climb_id, candidate_id, name: what names a summit; passes before saddles before peaks, then the nearest.

    Summits go to all cells in reach, candidates to their own, so the join is an equi-join.
    Candidates of a kind and height at one place are one (the smallest id), summits likewise ask once.
    """
    spot = ["latitude", "longitude", "elevation_m"]
    candidates = candidates.groupBy("kind", *spot).agg(F.min(F.struct("candidate_id", "name")).alias("_c")).select("kind", *spot, "_c.*")
    rows, columns, row, column = cells(max(m for m, _ in NAMING.values()), "latitude", "longitude", row="_row")
    key = F.struct(*spot).alias("_spot")
    asked = summits.select(*spot).distinct().withColumn("_row", rows).withColumn("_column", columns).select(key, "_row", "_column", *[F.col(c).alias(f"_{c}") for c in spot])
    near = asked.join(candidates.withColumn("_row", row).withColumn("_column", column), ["_row", "_column"])
    far = equirectangular_m(F.col("_latitude"), F.col("_longitude"), F.col("latitude"), F.col("longitude"))
    apart = F.coalesce(F.abs(F.col("elevation_m") - F.col("_elevation_m")), F.lit(0.0))
    fits = F.lit(False)
    for kind, (reach, up) in NAMING.items():
        limit = F.when(F.col("elevation_m").isNull(), PEAK_WITHOUT_ELEVATION_M).otherwise(reach) if kind == "peak" else F.lit(reach)
        fits = fits | ((F.col("kind") == kind) & (far <= limit) & (apart <= up))
    order = F.when(F.col("kind") == "mountain-pass", 0).when(F.col("kind") == "saddle", 1).otherwise(2)
    best = near.where(fits).groupBy("_spot").agg(F.min(F.struct(order.alias("p"), far.alias("far"), "candidate_id", "name")).alias("b"))
    best = summits.select("climb_id", key).join(best, "_spot").groupBy("climb_id").agg(F.min("b").alias("b"))
    return best.select("climb_id", F.col("b.candidate_id").alias("candidate_id"), F.col("b.name").alias("name"))


def custom_pauses(pauses: DataFrame, places: DataFrame) -> DataFrame:
    """day_id, place_id, pause_id, minutes: active pauses at known places; those of a day at one place are one, named by the first."""
    live = pauses.where("active and minutes > 0").join(places.select("place_id"), "place_id", "leftsemi")
    return live.groupBy("day_id", "place_id").agg(F.min_by("pause_id", F.struct("order", "pause_id")).alias("pause_id"), F.sum("minutes").alias("minutes"))


def stable_ids(places: DataFrame, prefix: str = "place") -> DataFrame:
    """Add stable_id, hashed from layer, name and place; what is equal in these has a number behind it, in order of place_id."""
    spot = [F.format_string("%.7f", F.col(c)) for c in ("latitude", "longitude")]
    identity = F.concat_ws("|", "layer", F.coalesce(F.lower("name"), F.lit("")), *spot)
    based = places.withColumn("_base", F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(identity, 256), 1, 14)))
    n = F.row_number().over(Window.partitionBy("_base").orderBy("place_id"))
    return based.withColumn("stable_id", F.concat("_base", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""))).drop("_base")


def without_endpoint_names(points: DataFrame, routes: DataFrame, within_km: float = 2.0) -> DataFrame:
    """Points (route_id, kind, name, track_km) but for localities that only repeat the name of the start or end nearby."""
    ends = routes.select("route_id", name_key(F.col("start_name")).alias("_start"), name_key(F.col("end_name")).alias("_end"), F.col("total_km").alias("_total"))
    keyed = points.join(ends, "route_id", "left").withColumn("_key", name_key(F.col("name")))
    again = (F.col("_key") == F.col("_start")) & (F.col("track_km") <= within_km) | (F.col("_key") == F.col("_end")) & (F.col("track_km") >= F.col("_total") - within_km)
    return keyed.where(~(F.col("kind").isin("city", "town", "village") & F.coalesce(again, F.lit(False)))).drop("_key", "_start", "_end", "_total")
