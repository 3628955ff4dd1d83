"""Edited trips: what a rebuilt trip takes over from the version before it.

A trip is edited as a list of slots, one for each new day, which may name the day
and the file that they keep.  Everything computed is rebuilt; identities and what
people or providers added are carried over to entities that the slots keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.functions.geo import haversine_km
from trailframe.operators.spatial import cells

#: A climb is the same if its ends moved less than this (km); an enriched one may end farther away.
SAME_KM, ENRICHED_END_KM = 0.05, 1.0


def slot_issues(slots: DataFrame, days: DataFrame) -> DataFrame:
    """Why a list of slots can't be applied: trip_id, position, code.

    slots: trip_id, position, kind, day_id, file_id (kept ones or null).
    days: trip_id, day_id, kind, file_id of the version before.
    """
    old = days.select("trip_id", "day_id", F.col("kind").alias("_kind"), F.col("file_id").alias("_file"))
    again = F.row_number().over(Window.partitionBy("trip_id", "day_id").orderBy("position")) > 1
    rows = slots.withColumn("_again", again & F.col("day_id").isNotNull()).join(old, ["trip_id", "day_id"], "left")
    code = (
        F.when(F.col("day_id").isNull(), None).when(F.col("_again"), "duplicate-day").when(F.col("_kind").isNull(), "unknown-day").when(F.col("_kind") != F.col("kind"), "kind-changed")
        .when((F.col("kind") == "ride") & F.col("file_id").isNotNull() & ~F.col("file_id").eqNullSafe(F.col("_file")), "file-mismatch")
    )
    found = rows.select("trip_id", "position", code.alias("code")).where("code is not null")
    none = slots.groupBy("trip_id").agg(F.count_if(F.col("kind") == "ride").alias("_n")).where("_n = 0")
    return found.union(none.select("trip_id", F.lit(None).cast(dict(slots.dtypes)["position"]), F.lit("no-ride")))


def identities(slots: DataFrame, old_days: DataFrame, new_days: DataFrame) -> DataFrame:
    """New ids and the ids that they keep: trip_id, entity (day, stage, route, file), new_id, kept_id.

    A slot's day keeps its id; its stage, route and file do so only if it is a ride
    whose file is kept.  old_days: trip_id, day_id, stage_id, route_id, file_id; new_days: with position.
    """
    old = old_days.select("trip_id", *(F.col(f"{e}_id").alias(f"_{e}") for e in ("day", "stage", "route", "file")))
    asked = slots.select("trip_id", "position", "kind", F.col("day_id").alias("_day"), F.col("file_id").alias("_kept"))
    rows = asked.join(old, ["trip_id", "_day"]).join(new_days.select("trip_id", "position", "day_id", "stage_id", "route_id", "file_id"), ["trip_id", "position"])
    same = (F.col("kind") == "ride") & F.col("_kept").isNotNull()
    pair = lambda e: F.struct(F.lit(e).alias("entity"), F.col(f"{e}_id").cast("string").alias("new_id"), F.col(f"_{e}").cast("string").alias("kept_id"))
    each = F.when(same, F.array(*(pair(e) for e in ("day", "stage", "route", "file")))).otherwise(F.array(pair("day")))
    return rows.select("trip_id", F.inline(each)).where("new_id is not null and kept_id is not null")


def by_fingerprint(old: DataFrame, new: DataFrame, within_km: float = SAME_KM) -> DataFrame:
    """Files of two versions of a trip that are the same, one to one: trip_id, old_id, new_id, state (kept, moved, new, dropped).

    old and new: trip_id, file_id, fingerprint, latitude, longitude (start).  Equal
    fingerprints come first, in order of ids where several are equal.  What is left
    is matched by place: pairs within reach, nearest first, each file once.  That
    choice is a fold over the few pairs of one trip.
    """

    def numbered(rows: DataFrame, name: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("trip_id", "fingerprint").orderBy("file_id"))
        return rows.select("trip_id", "fingerprint", F.col("file_id").alias(name), n.alias("_n"))

    first = numbered(old.where("fingerprint is not null"), "old_id").join(numbered(new.where("fingerprint is not null"), "new_id"), ["trip_id", "fingerprint", "_n"])
    found = first.select("trip_id", "old_id", "new_id", F.lit("kept").alias("state"))
    a = old.join(found.select("trip_id", F.col("old_id").alias("file_id")), ["trip_id", "file_id"], "left_anti").select("trip_id", F.col("file_id").alias("old_id"), "latitude", "longitude")
    b = new.join(found.select("trip_id", F.col("new_id").alias("file_id")), ["trip_id", "file_id"], "left_anti").select("trip_id", F.col("file_id").alias("new_id"), F.col("latitude").alias("_la"), F.col("longitude").alias("_lo"))
    rows, columns, _, _ = cells(within_km * 1000, "_la", "_lo")
    _, _, r, c = cells(within_km * 1000, "latitude", "longitude")
    far = haversine_km(F.col("latitude"), F.col("longitude"), F.col("_la"), F.col("_lo"))
    dealt = b.withColumn("_r", rows).withColumn("_c", columns)
    pairs = a.withColumn("_r", r).withColumn("_c", c).join(dealt, ["trip_id", "_r", "_c"]).withColumn("far", far).where(F.col("far") <= within_km).select("trip_id", "old_id", "new_id", "far")
    row = F.array_sort(F.collect_list(F.struct("far", "old_id", "new_id")))
    kind = dict(pairs.dtypes)
    chosen = F.expr(
        f"aggregate(rows, cast(array() as array<struct<old_id:{kind['old_id']},new_id:{kind['new_id']}>>), (s, p) -> "
        "if(exists(s, x -> x.old_id = p.old_id or x.new_id = p.new_id), s, concat(s, array(struct(p.old_id as old_id, p.new_id as new_id)))))"
    )
    moved = pairs.groupBy("trip_id").agg(row.alias("rows")).select("trip_id", F.inline(chosen))
    found = found.union(moved.select("trip_id", "old_id", "new_id", F.lit("moved")))
    lost = old.select("trip_id", F.col("file_id").alias("old_id")).join(found, ["trip_id", "old_id"], "left_anti")
    fresh = new.select("trip_id", F.col("file_id").alias("new_id")).join(found, ["trip_id", "new_id"], "left_anti")
    return found.unionByName(lost.withColumn("state", F.lit("dropped")), allowMissingColumns=True).unionByName(fresh.withColumn("state", F.lit("new")), allowMissingColumns=True)


def manual(source: Column, overridden: Column) -> Column:
    return (source == "user") | F.coalesce(overridden, F.lit(False))


def carried(ids: DataFrame, entity: str, rows: DataFrame, column: str) -> DataFrame:
    """Rows of the rebuilt trip with `column` led back to the id that it keeps."""
    known = ids.where(F.col("entity") == entity).select(F.col("trip_id").alias("_trip"), F.col("new_id").alias("_new"), F.col("kept_id").alias("_kept"))
    met = rows.join(known, (F.col("trip_id") == F.col("_trip")) & (F.col(column) == F.col("_new")), "left")
    return met.withColumn(column, F.coalesce("_kept", column)).drop("_trip", "_new", "_kept")


def merged_climbs(ids: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Climbs after an edit: trip_id, climb_id, route_id, start_km, end_km, name, origin (rebuilt, renamed, enriched, manual).

    old and new: trip_id, ordinal, climb_id, route_id, start_km, end_km, name, source, engine, overridden.
    On kept routes, a rebuilt climb takes the name of the first old one that a
    provider named, if both ends are within reach; an enriched one is taken over
    whole.  Climbs made by hand stay, unless the rebuilt trip has their id.
    """
    kept = ids.where("entity = 'route'").select("trip_id", F.col("kept_id").alias("route_id"))
    stays = old.join(kept, ["trip_id", "route_id"], "left_semi")
    rebuilt = carried(ids, "route", new, "route_id")
    enriched = F.col("engine").startswith("route-enrichment@")
    named = stays.where((F.col("source") == "osm") & (enriched | (F.col("engine") == "climb-name-enrichment@1")))
    named = named.select("trip_id", "route_id", F.struct("ordinal", "start_km", "end_km", "name", enriched.alias("enriched")).alias("o"))
    near = (F.abs(F.col("o.start_km") - F.col("start_km")) <= SAME_KM) & (F.abs(F.col("o.end_km") - F.col("end_km")) <= F.when(F.col("o.enriched"), ENRICHED_END_KM).otherwise(SAME_KM))
    first = rebuilt.join(named, ["trip_id", "route_id"]).where(near).groupBy("trip_id", "climb_id").agg(F.min("o").alias("o"))
    base = rebuilt.join(first, ["trip_id", "climb_id"], "left")
    whole = F.coalesce(F.col("o.enriched"), F.lit(False))
    taken = lambda c: F.when(whole, F.col(f"o.{c}")).otherwise(F.col(c)).alias(c)
    base = base.select("trip_id", "climb_id", "route_id", taken("start_km"), taken("end_km"), F.when(F.col("o").isNotNull(), F.col("o.name")).otherwise(F.col("name")).alias("name"),
        F.when(whole, "enriched").when(F.col("o").isNotNull(), "renamed").otherwise("rebuilt").alias("origin"))
    by_hand = stays.where(manual(F.col("source"), F.col("overridden"))).join(new.select("trip_id", "climb_id"), ["trip_id", "climb_id"], "left_anti")
    return base.unionByName(by_hand.select("trip_id", "climb_id", "route_id", "start_km", "end_km", "name", F.lit("manual").alias("origin")))


def merged_points(ids: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Route points after an edit: the rebuilt ones, and on kept routes those made by hand, geocoded ends and enrichments, unless the id stands already.

    old and new: trip_id, point_id, route_id, kind, source, engine, overridden.
    """
    kept = ids.where("entity = 'route'").select("trip_id", F.col("kept_id").alias("route_id"))
    osm = F.col("source") == "osm"
    stays = manual(F.col("source"), F.col("overridden")) | (F.col("kind").isin("start", "end") & osm & (F.col("engine") == "endpoint-geocoding@1")) | (osm & F.col("engine").startswith("route-enrichment@"))
    retained = old.join(kept, ["trip_id", "route_id"], "left_semi").where(F.coalesce(stays, F.lit(False))).join(new.select("trip_id", "point_id"), ["trip_id", "point_id"], "left_anti")
    columns = ["trip_id", "point_id", "route_id", "kind"]
    return carried(ids, "route", new, "route_id").select(*columns, F.lit("rebuilt").alias("origin")).union(retained.select(*columns, F.lit("retained")))


def merged_days(ids: DataFrame, slots: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Days after an edit, under the ids that they keep, with the lodging, notes and state of the day they were.

    old: trip_id, day_id, lodging_id, notes, enrichment; new: trip_id, position, day_id, stage_id, notes, enrichment.
    """
    rows = carried(ids, "stage", carried(ids, "day", new, "day_id"), "stage_id")
    was = old.select("trip_id", F.col("day_id").alias("_day"), F.col("lodging_id").alias("lodging_id"), F.col("notes").alias("_notes"), F.col("enrichment").alias("_enrichment"))
    asked = slots.select("trip_id", "position", F.col("day_id").alias("_day"))
    met = rows.join(asked, ["trip_id", "position"], "left").join(was, ["trip_id", "_day"], "left")
    return met.select("trip_id", "position", "day_id", "stage_id", "lodging_id", F.coalesce("_notes", "notes").alias("notes"), F.coalesce("_enrichment", "enrichment").alias("enrichment"))


def surviving_overrides(overrides: DataFrame, targets: DataFrame) -> DataFrame:
    """Overrides (trip_id, target_type, target_id, ...) whose target is still there; targets: trip_id, target_type, target_id."""
    return overrides.join(targets.select("trip_id", "target_type", "target_id").distinct(), ["trip_id", "target_type", "target_id"], "left_semi")
