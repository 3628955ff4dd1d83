"""What weather is asked for: sample points of every day of a trip, and their places packed into requests of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: places of a request at most.
REQUEST_PLACES = 16
#: What a waypoint counts as for the weather.
ROLES = {
    "start": "start", "end": "end", "mountain-pass": "col", "saddle": "col", "climb": "summit", "city": "passage", "town": "passage", "village": "passage", "pause": "pause",
}
SAMPLE = ("trip_id", "key", "date", "sample_id", "name", "role", "latitude", "longitude", "elevation_m", "elapsed_minutes")


def neighbours(days: DataFrame, ends: DataFrame) -> DataFrame:
    """Add before (end of the last ride before) and after (start of the next one): structs of (latitude, longitude, elevation_m), null without.

    days: trip_id, day_id, index, kind, date, name, origin, destination.
    ends: trip_id, day_id, and start and end, structs of (latitude, longitude, elevation_m).
    """
    met = days.join(ends.select("trip_id", "day_id", F.col("start").alias("_s"), F.col("end").alias("_e")), ["trip_id", "day_id"], "left")
    ride = F.col("kind") == "ride"
    w = Window.partitionBy("trip_id").orderBy("index")
    before = F.last(F.when(ride, F.col("_e")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(ride, F.col("_s")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return met.withColumn("before", before).withColumn("after", after).drop("_s", "_e")


def definitions(days: DataFrame, ends: DataFrame, waypoints: DataFrame) -> DataFrame:
    """Sample points of all dated days, and a row with a reason where a day can have none.

    A ride is asked for at its significant waypoints with a time; a day off at its
    named place, with the coordinates of the neighbouring ride; a transfer is two
    days of its own, at the end of the ride before and the start of the next
    (keys <day>::origin and <day>::destination), each only with a name and a place.
    waypoints: day_id, waypoint_id, name, kind, latitude, longitude, elevation_m, elapsed_minutes, significant.
    """
    dated = neighbours(days, ends).where("date is not null")
    flat = F.coalesce("elevation_m", F.lit(0.0)).alias("elevation_m")
    some = waypoints.where("significant and elapsed_minutes is not null")
    role = F.element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), F.col("w_kind"))
    rides = dated.where("kind = 'ride'").select("trip_id", "day_id", "date").join(some.withColumnRenamed("kind", "w_kind"), "day_id", "left")
    ride = rides.select("trip_id", F.col("day_id").alias("key"), "date", F.col("waypoint_id").alias("sample_id"), "name", role.alias("role"), "latitude", "longitude", flat, "elapsed_minutes",
        F.when(F.col("waypoint_id").isNull(), "no-point").alias("reason"))
    none = lambda kind: F.lit(None).cast(kind)
    place = F.coalesce("before", "after")
    reason = F.when(F.col("name").isNull(), "place-unknown").when(place.isNull(), "coordinates-unknown")
    stays = dated.where("kind = 'off'").withColumn("_reason", reason).withColumn("_p", F.when(F.col("_reason").isNull(), place))
    off = stays.select("trip_id", F.col("day_id").alias("key"), "date", F.when(F.col("_reason").isNull(), F.concat("day_id", F.lit(":off-location"))).alias("sample_id"), F.when(F.col("_reason").isNull(), F.col("name")).alias("name"),
        F.when(F.col("_reason").isNull(), "off-location").alias("role"), "_p.latitude", "_p.longitude", F.when(F.col("_p").isNotNull(), F.coalesce("_p.elevation_m", F.lit(0.0))).alias("elevation_m"), none("double").alias("elapsed_minutes"),
        F.col("_reason").alias("reason"))
    sides = F.array(*(
        F.struct(F.concat("day_id", F.lit(f"::{side}")).alias("key"), F.col(side).alias("name"), F.col(at).alias("_p")) for side, at in (("origin", "before"), ("destination", "after"))
    ))
    moves = dated.where("kind = 'transfer'").select("trip_id", "date", F.inline(sides)).where("name is not null and _p is not null")
    transfer = moves.select("trip_id", "key", "date", F.concat("key", F.lit(":location")).alias("sample_id"), "name", F.lit("off-location").alias("role"), "_p.latitude", "_p.longitude",
        F.coalesce("_p.elevation_m", F.lit(0.0)).alias("elevation_m"), none("double").alias("elapsed_minutes"), none("string").alias("reason"))
    return ride.union(off).union(transfer)


def packed(samples: DataFrame, most: int = REQUEST_PLACES) -> DataFrame:
    """Requests of at most `most` distinct places of a key each: key, request, place, latitude, longitude, elevation_m and samples (their ids, sorted).

    Sample points at one place are asked for once; places are numbered in the order
    of their smallest sample id, from 0 in every request.
    """
    places = samples.where("sample_id is not null").groupBy("trip_id", "key", "latitude", "longitude").agg(F.max("elevation_m").alias("elevation_m"), F.array_sort(F.collect_set("sample_id")).alias("samples"))
    n = F.row_number().over(Window.partitionBy("trip_id", "key").orderBy(F.col("samples")[0])) - 1
    rows = places.withColumn("_n", n).withColumn("request", F.floor(F.col("_n") / most).cast("int")).withColumn("place", (F.col("_n") % most).cast("int"))
    return rows.select("trip_id", "key", "request", "place", "latitude", "longitude", "elevation_m", "samples")


def answered(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (trip_id, key, request, place, payload) back at their sample points; state: available, or missing where no answer has the place."""
    met = requests.join(answers.select("trip_id", "key", "request", "place", "payload"), ["trip_id", "key", "request", "place"], "left")
    return met.select("trip_id", "key", F.explode("samples").alias("sample_id"), "payload", F.when(F.col("payload").isNotNull(), "available").otherwise("missing").alias("state"))
