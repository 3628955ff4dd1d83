"""From analysed files to stages, days and the document of a trip.

One file is one stage and one day of riding.  Collections are gathered by trip: a
trip's document is as large as its days, and trips are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERSION = 1
#: What stands where no place is known. Fixed values.
START, END = "Départ étape ", "Arrivée étape "


def listed(few: DataFrame, item: str, *more: str) -> DataFrame:
    """route_id, items: the rows of a route by their ordinal and id, as structs of ordinal, id and more."""
    return few.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", item, *more))).alias("items"))


def staged(files: DataFrame, trips: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """A row for each file, in order: its stage and its day, with lists (route_id, items) of its route; of a route without one, the list is empty.  trips' columns come along."""
    order = Window.partitionBy("trip_id").orderBy("position", "route_id")
    rows = files.join(trips, "trip_id").withColumn("index", F.row_number().over(order) - 1).withColumn("display_number", F.col("index") + 1)
    for name, few in lists.items():
        rows = rows.join(few.withColumnRenamed("items", name), "route_id", "left").withColumn(name, F.coalesce(name, F.array().cast(few.schema["items"].dataType)))
    label = lambda text: F.concat(F.lit(text), F.col("display_number").cast("string"))
    named = lambda prefix: F.concat(F.lit(prefix), F.col("route_id").cast("string"))
    return rows.withColumns({
        "stage_id": named("stage-"), "day_id": named("day-"), "start_name": label(START), "end_name": label(END), "date": F.date_add("start_date", F.col("index")),
        "validation": F.when(F.col("status") == "success", "valid").otherwise("needs-review"),
    }).drop("start_date")


def built_stages(files: DataFrame, trips: DataFrame, points: DataFrame, climbs: DataFrame) -> DataFrame:
    """A row for each file, in order: its stage and its day.

    files: trip_id, position, route_id, name, status, distance_km, gain_m, loss_m, min_m,
    max_m, moving_s, pause_s, total_s, average_kph (each may be null); trips: trip_id,
    start_date (null: no dates); points and climbs: route_id, ordinal and their id.
    Ties of position go to the smaller route_id.  Files that weren't read without
    fault need a review.
    """
    ids = {name: listed(few, item).withColumn("items", F.col(f"items.{item}")) for few, item, name in ((points, "point_id", "point_ids"), (climbs, "climb_id", "climb_ids"))}
    return staged(files, trips.select("trip_id", "start_date"), ids)


def dated(trips: DataFrame) -> DataFrame:
    """trip_calendar of trips that know their n_days."""
    dates = F.col("start_date").isNotNull()
    end = F.when(dates & (F.col("n_days") > 0), F.expr("date_add(start_date, cast(n_days - 1 as int))"))
    return trips.withColumns({"end_date": end, "timezone": F.when(dates, F.col("timezone")), "status": F.when(dates, "ready").otherwise("draft")})


def trip_calendar(trips: DataFrame, stages: DataFrame) -> DataFrame:
    """Trips with end_date, timezone (null where there are no dates), status (ready or draft) and n_days; trips without a file have no end, which the
    document rules report where there is a start."""
    n = stages.groupBy("trip_id").agg(F.count("*").alias("_n"))
    return dated(trips.join(n, "trip_id", "left").withColumn("n_days", F.coalesce("_n", F.lit(0))).drop("_n"))


def provenance(engine: Column, kind: str = "gpx") -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("sourceType"), none.alias("sourceId"), none.alias("fetchedAt"), engine.alias("engineVersion"), none.alias("confidence"), F.lit(False).alias("manuallyOverridden"))


def renamed(**columns: str | Column) -> Column:
    """A struct of fields: a text names a column."""
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def assembled(trips: DataFrame, files: DataFrame, points: DataFrame, climbs: DataFrame) -> DataFrame:
    """trip_id, document (a variant): the whole document of each trip.

    Besides what built_stages reads: trips have slug, name, timezone, language, units,
    departure, reference_kph, mountains, imported_at (ISO text), engine; files have file_name,
    mime_type, bytes, sha256; points have kind, name, latitude, longitude, elevation_m,
    track_km; climbs have name, start_km, end_km, gain_m, average_grade, max_grade, start_m,
    end_m.  Weather, places and lodgings come later: their collections are empty.
    """
    text = lambda c: F.col(c).cast("string")
    none = lambda kind="string": F.lit(None).cast(kind)
    string = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    nothing = F.array().cast("array<string>")
    lists = {
        "_points": listed(points, "point_id", "kind", "name", "latitude", "longitude", "elevation_m", "track_km"),
        "_climbs": listed(climbs, "climb_id", "name", "start_km", "end_km", "gain_m", "average_grade", "max_grade", "start_m", "end_m"),
    }
    stages = staged(files, trips.select("trip_id", "start_date"), lists)
    # a trip's stages meet in one row once, with what is on their routes; the collections are made of that row
    fields = sorted(set(stages.columns) - {"trip_id", "position", "index"})
    every = F.array_sort(F.collect_list(F.struct("index", F.struct(*fields).alias("_stage"))))
    rows = trips.join(stages.groupBy("trip_id").agg(every.alias("_stages")), "trip_id", "left").withColumn("n_days", F.coalesce(F.size("_stages"), F.lit(0)))
    rows = dated(rows.withColumn("n_days", F.greatest("n_days", F.lit(0))))
    engine, source = F.col("engine"), provenance(F.col("engine"))

    def made(body) -> Column:
        """The stages of a trip as structs: body(stage, its index) gives the fields."""
        return F.coalesce(F.transform("_stages", lambda s: renamed(**body(s["_stage"], s["index"]))), F.array())

    def inside(items: str, body) -> Column:
        """What is on the routes of all stages, in order: body(item, its route) gives the fields."""
        return F.coalesce(F.flatten(F.transform("_stages", lambda s: F.transform(s["_stage"][items], lambda x: renamed(**body(x, string("route-", s["_stage"]["route_id"])))))), F.array())

    parts = {
        "days": made(lambda s, i: dict(
            id=s["day_id"], index=i, displayNumber=s["display_number"], date=s["date"].cast("string"), type=F.lit("ride"), stageId=s["stage_id"], startLocationName=s["start_name"], endLocationName=s["end_name"],
            accommodationId=none(), notes=none(), enrichmentStatus=F.lit("not-started"),
        )),
        "stages": made(lambda s, i: dict(
            id=s["stage_id"], dayId=s["day_id"], sourceRouteId=string("route-", s["route_id"]), name=s["name"], startLocationName=s["start_name"], endLocationName=s["end_name"], distanceKm=s["distance_km"],
            elevationGainM=s["gain_m"], elevationLossM=s["loss_m"], minAltitudeM=s["min_m"], maxAltitudeM=s["max_m"], movingDurationSeconds=s["moving_s"], pauseDurationSeconds=s["pause_s"],
            totalDurationSeconds=s["total_s"], estimatedAverageSpeedKph=s["average_kph"], validationStatus=s["validation"], metricsProvenance=source,
            climbIds=F.transform(s["_climbs"], lambda x: string("climb-", x["climb_id"])), routePointIds=F.transform(s["_points"], lambda x: string("point-", x["point_id"])), weatherRecordIds=nothing,
        )),
        "sourceFiles": made(lambda s, i: dict(
            id=string("file-", s["route_id"]), originalName=s["file_name"], mimeType=s["mime_type"], sizeBytes=s["bytes"], lastModifiedAt=none(), sha256=s["sha256"], importedAt=F.col("imported_at"),
            parsingStatus=s["status"], parsingErrors=nothing,
        )),
        "routes": made(lambda s, i: dict(
            id=string("route-", s["route_id"]), sourceFileId=string("file-", s["route_id"]),
            segments=F.array(renamed(index=F.lit(0), name=s["name"], distanceKm=s["distance_km"], elevationGainM=s["gain_m"], elevationLossM=s["loss_m"])), geometry=none(), profile=none(), parsingStatus=s["status"],
            parsingErrors=nothing, provenance=source,
        )),
        "climbs": inside("_climbs", lambda x, route: dict(
            id=string("climb-", x["climb_id"]), routeId=route, name=x["name"], startDistanceKm=x["start_km"], endDistanceKm=x["end_km"], elevationGainM=x["gain_m"], averageGradientPercent=x["average_grade"],
            maxGradientPercent=x["max_grade"], startAltitudeM=x["start_m"], endAltitudeM=x["end_m"], confidence=F.lit("probable"), provenance=source,
        )),
        "routePoints": inside("_points", lambda x, route: dict(
            id=string("point-", x["point_id"]), routeId=route, type=x["kind"], name=x["name"], latitude=x["latitude"], longitude=x["longitude"], elevationM=x["elevation_m"], trackDistanceKm=x["track_km"],
            provenance=provenance(engine, "osm"),
        )),
    }
    breaks = made(lambda s, i: dict(dayId=s["day_id"], departureTime=F.col("departure"), totalBreakSeconds=s["pause_s"]))
    start, end = text("start_date"), text("end_date")
    document = renamed(
        schemaVersion=F.lit(VERSION),
        metadata=renamed(
            id=text("trip_id"), slug="slug", name="name", description=none(), createdAt="imported_at", updatedAt="imported_at", startDate=start, endDate=end, timezone="timezone", language="language", units="units",
            status="status", schemaVersion=F.lit(VERSION), engineVersion="engine",
        ),
        calendar=renamed(startDate=start, endDate=end, timezone="timezone"),
        **parts, practicalPlaces=nothing, accommodations=nothing, weather=nothing,
        settings=renamed(**{"global": renamed(referenceSpeedKph="reference_kph", pausePlanMode=F.lit("automatic"), mountainMode="mountains"), "days": breaks, "stages": nothing}),
        overrides=nothing, enrichmentMetadata=renamed(providers=nothing), generatedMetadata=renamed(engineVersion="engine", generatedAt="imported_at", derivedDataStatus=F.lit("fresh")),
    )
    return rows.select("trip_id", F.parse_json(F.to_json(document, {"ignoreNullFields": "false"})).alias("document"))
