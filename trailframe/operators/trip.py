"""Trips, days and stages: lookups, totals, calendar, neighbours, selection, replacement by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def members_in_order(parents: DataFrame, ids: str, children: DataFrame, child_id: str) -> DataFrame:
    """Children of an array of ids, one row each with its position; ids without a child drop out."""
    return parents.select("*", F.posexplode(ids).alias("pos", child_id)).drop(ids).join(children, child_id)


def holding(parents: DataFrame, ids: str, wanted: DataFrame, wanted_id: str) -> DataFrame:
    """Rows whose array of ids holds a wanted one (exploded to an equi-join; an id counts once)."""
    return parents.select("*", F.explode(F.array_distinct(ids)).alias(wanted_id)).drop(ids).join(wanted, wanted_id)


def planned_files(plan: DataFrame, files: DataFrame) -> DataFrame:
    """Every planned or present file name and whether it matches exactly once."""
    a = plan.groupBy("file_name").agg(F.count("*").alias("planned"))
    b = files.groupBy("file_name").agg(F.count("*").alias("present"))
    rows = a.join(b, "file_name", "full").fillna(0, ["planned", "present"])
    status = (
        F.when(F.col("planned") == 0, "unplanned").when(F.col("present") == 0, "missing").when((F.col("planned") > 1) | (F.col("present") > 1), "ambiguous").otherwise("ok")
    )
    return rows.withColumn("status", status)


def trip_totals(days: DataFrame) -> DataFrame:
    """Three conventions for missing values side by side: sum of the known, missing as zero, all or nothing."""
    km = F.col("distance_km")
    whole = F.when(F.count(km) == F.count_if(F.col("kind") == "ride"), F.sum(km))
    return days.groupBy("trip_id").agg(
        F.count("*").alias("days"), F.count_if(F.col("kind") == "ride").alias("rides"), F.count_if(F.col("kind") == "off").alias("offs"),
        F.count_if(F.col("kind") == "transfer").alias("transfers"), F.count_if(~F.col("attached")).alias("calendar_days"),
        F.sum(km).alias("known_km"), F.sum(F.coalesce(km, F.lit(0.0))).alias("zero_km"), whole.alias("complete_km"),
        F.sum("gain_m").alias("gain_m"),
    )


def calendar(days: DataFrame, start: Column) -> DataFrame:
    """Renumber days by position; the date is the start plus the index, attached transfers included."""
    w = Window.partitionBy("trip_id").orderBy("position")
    index = F.row_number().over(w) - 1
    number = F.sum((~F.col("attached")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return days.withColumn("index", index).withColumn("display_number", number).withColumn("date", F.date_add(start, F.col("index")))


def fill_places(days: DataFrame) -> DataFrame:
    """Where a day without a ride is spent: set by hand, else the arrival of the ride before, else the departure of the next.

    The nearest ride counts even if it has no name, so the struct carries its presence.
    """
    w = Window.partitionBy("trip_id").orderBy("position")
    ride = F.when(F.col("kind") == "ride", F.struct("departure", "arrival"))
    rows = days.withColumn("_ride", ride)
    before = F.last("_ride", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("trip_id").orderBy(F.desc("position"))
    after = F.last("_ride", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_b", before).withColumn("_a", after)
    place = F.when(F.col("manual").isNotNull(), F.col("manual")).when(F.col("_b").isNotNull(), F.col("_b.arrival")).otherwise(F.col("_a.departure"))
    source = F.when(F.col("manual").isNotNull(), "manual").when(F.col("_b").isNotNull(), "previous").when(F.col("_a").isNotNull(), "next").otherwise("none")
    return rows.where("kind <> 'ride'").select("trip_id", "position", place.alias("place"), source.alias("source"))


def progress(days: DataFrame, today) -> DataFrame:
    """Done (before today), left, and the next day to come."""
    done = F.col("date") < today
    km = F.coalesce("distance_km", F.lit(0.0))
    return days.groupBy("trip_id").agg(
        F.count_if(done).alias("days_done"), F.count_if(~done).alias("days_left"), F.sum(F.when(done, km).otherwise(0.0)).alias("km_done"), F.sum(km).alias("km_total"),
        F.min(F.when(~done, F.col("date"))).alias("next_date"),
    )


def highlighted(days: DataFrame, today) -> DataFrame:
    """The day of today, else the first to come, else none."""
    return days.groupBy("trip_id").agg(F.min_by("position", F.when(F.col("date") >= today, F.col("date"))).alias("position"))


def preferred_trip(trips: DataFrame, today) -> DataFrame:
    """Per owner: a trip under way, else the next one, else the last one past; ties to the smaller id."""
    stage = F.when((F.col("first_date") <= today) & (F.col("last_date") >= today), 0).when(F.col("first_date") > today, 1).otherwise(2)
    far = F.when(stage == 2, F.datediff(today, F.col("last_date"))).when(stage == 1, F.datediff(F.col("first_date"), today)).otherwise(0)
    best = F.min(F.struct(stage.alias("stage"), far.alias("far"), F.col("trip_id"))).alias("b")
    return trips.groupBy("owner").agg(best).select("owner", F.col("b.trip_id").alias("trip_id"), F.col("b.stage").alias("stage"))


def reference_points(points: DataFrame) -> DataFrame:
    """Start, highest pass and finish of each day, each point once."""
    rows = points.groupBy("day_id").agg(
        F.min_by("point_id", F.struct("eta", "point_id")).alias("a"),
        F.max_by("point_id", F.when(F.col("kind") == "col", F.struct(F.col("elevation_m"), (-F.col("point_id")).alias("n")))).alias("b"),
        F.max_by("point_id", F.struct("eta", "point_id")).alias("c"),
    )
    return rows.select("day_id", F.explode(F.array_distinct(F.array_compact(F.array("a", "b", "c")))).alias("point_id"))


def allocate(rows: DataFrame, group: str, order: tuple[str, ...], total: str, share: str) -> DataFrame:
    """Largest remainder: whole parts that sum to a whole total, spare units to the largest fractions, then in order."""
    w = Window.partitionBy(group)
    exact = F.col(total) * F.col(share) / F.sum(share).over(w)
    parts = rows.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact")).withColumn("_rest", F.col("_exact") - F.col("_floor"))
    spare = F.col(total) - F.sum("_floor").over(w)
    place = F.row_number().over(w.orderBy(F.desc("_rest"), *order))
    return parts.withColumn("allocated", (F.col("_floor") + F.when(place - 1 < spare, 1).otherwise(0)).cast("long")).drop("_exact", "_floor", "_rest")


def replace_by_key(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of `new` take the place of old rows with the same key."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def unknown_ids(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_anti")


def unique_matches(left: DataFrame, right: DataFrame, key: str, right_id: str) -> DataFrame:
    """Equi-matches that are accepted only where exactly one row on the right has the key."""
    single = right.groupBy(key).agg(F.count("*").alias("_n"), F.min(right_id).alias(right_id)).where("_n = 1").drop("_n")
    return left.join(single, key)


def status_rollup(rows: DataFrame, group: str, ok: Column) -> DataFrame:
    """success, partial or error, from how many parts went well."""
    good = F.count_if(ok)
    status = F.when(good == F.count("*"), "success").when(good > 0, "partial").otherwise("error")
    return rows.groupBy(group).agg(F.count("*").alias("parts"), good.alias("good"), status.alias("status"))


def layer_counts(places: DataFrame) -> DataFrame:
    """Places, named ones and the sorted categories of each layer."""
    return places.groupBy("layer").agg(
        F.count("*").alias("places"), F.count("name").alias("named"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories")
    )


def table_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of two versions of a table that differ: added, removed or changed."""
    rest = [c for c in left.columns if c != key]
    a = left.select(F.col(key).alias("_l"), F.struct(*rest).alias("_a"))
    b = right.select(F.col(key).alias("_r"), F.struct(*[F.col(c) for c in rest]).alias("_b"))
    both = a.join(b, F.col("_l") == F.col("_r"), "full")
    change = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(F.coalesce("_l", "_r").alias(key), change.alias("change")).where("change is not null")


#: Pauses of a day without a plan: name, place as a share of the way, share of the break. Fixed values.
PAUSE_RULES = (("morning", 0.25, 0.25), ("main", 0.5, 0.5), ("afternoon", 0.75, 0.25))


def automatic_pauses(rides: DataFrame) -> DataFrame:
    """day_id, rule, km, minutes: whole minutes of a day's break (day_id, total_km, break_minutes) at fixed shares of the way."""
    rules = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("rule"), F.lit(at).alias("_at"), F.lit(part).alias("_part")) for i, (n, at, part) in enumerate(PAUSE_RULES)])
    rows = rides.where("total_km > 0 and break_minutes > 0").select("day_id", "total_km", "break_minutes", F.inline(rules))
    shared = allocate(rows, "day_id", ("position",), "break_minutes", "_part").where("allocated > 0")
    return shared.select("day_id", "rule", (F.col("total_km") * F.col("_at")).alias("km"), F.col("allocated").alias("minutes"))


def all_or_nothing(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """Sums that are null as soon as one row of the group has no value."""
    return rows.groupBy(group).agg(*[F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)).alias(c) for c in columns])


def job_states(log: DataFrame, job: str, order: tuple[str, ...], *columns: str) -> DataFrame:
    """The state of each job from its log: of every column, the last value that was set."""
    return log.groupBy(job).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns], F.count("*").alias("steps"))
