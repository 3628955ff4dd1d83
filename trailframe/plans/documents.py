"""Trips as whole documents with planted faults, and their validation, with the SQL (DuckDB) of what must be found."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.operators import rules
from trailframe.plans.carriers import table

#: Kinds of planted faults; a trip has that of its number by their count.
FAULTS = 29


def filled(template: str) -> str:
    """SQL: a text in which <<...>> gives way to the SQL between."""
    parts = re.split(r"<<(.*?)>>", template, flags=re.S)
    return "concat(" + ", ".join(f"'{' '.join(p.split())}'" if i % 2 == 0 else f"cast({p} as string)" for i, p in enumerate(parts)) + ")"


def at(fault: int, bad: str, good: str) -> str:
    """In a template: `bad` in the first item of a trip with this fault."""
    return f"<<if(m = {fault} and i = 0, '{bad}', '{good}')>>"


SOURCE = '{"sourceType":"gpx","sourceId":null,"fetchedAt":null,"engineVersion":"e@1","confidence":null,"manuallyOverridden":false}'
DAY = (
    '{"id":"d<<k>>","index":<<if(m = 20 and i = 0, 5, i)>>,"displayNumber":<<i + 1>>,"date":"<<if(m = 16 and i = 0, date\'2030-01-01\', date_add(date\'2024-01-01\', i))>>",'
    f'"type":"{at(17, "off", "ride")}","stageId":"s<<k>>","startLocationName":null,"endLocationName":null,"accommodationId":"a<<t>>","notes":null,"enrichmentStatus":"partial"}}'
)
STAGE = (
    '{"id":"s<<k>>","dayId":"d<<if(m = 22 and i = 0 and n > 1, get(ks, i + 1), k)>>","sourceRouteId":"r<<k>>","name":null,"startLocationName":null,"endLocationName":null,"distanceKm":10.5,"elevationGainM":100,"elevationLossM":90,'
    f'"movingDurationSeconds":3600,"pauseDurationSeconds":600,"totalDurationSeconds":{at(18, "4000", "4200")},"estimatedAverageSpeedKph":15,"metricsProvenance":{SOURCE},"minAltitudeM":500,"maxAltitudeM":900,'
    '"validationStatus":"valid","climbIds":["c<<k>>"],"routePointIds":["p<<k>>"],"weatherRecordIds":["w<<k>>"]}'
)
ROUTE = (
    '{"id":"r<<k>>","sourceFileId":"f<<k>>","segments":[{"index":0,"name":null,"distanceKm":5,"elevationGainM":null,"elevationLossM":null},'
    f'{{"index":{at(12, "2", "1")},"name":"x","distanceKm":5,"elevationGainM":null,"elevationLossM":null}}],'
    f'"geometry":{{"full":[{{"latitude":45,"longitude":6,"altitudeM":null}},{{"latitude":{at(28, "95", "45.1")},"longitude":6.1,"altitudeM":700}}],"simplified":null}},'
    f'"profile":{{"resampleIntervalMeters":50,"points":[{{"distanceKm":0,"elevationM":1,"gradePercent":null}},{{"distanceKm":1,"elevationM":null,"gradePercent":2}},{{"distanceKm":{at(13, "1", "2")},"elevationM":3,"gradePercent":4}}]}},'
    f'"parsingStatus":"success","parsingErrors":[],"provenance":{SOURCE}}}'
)
FILE = '{"id":"f<<k>>","originalName":"a.gpx","mimeType":"application/gpx+xml","sizeBytes":100,"lastModifiedAt":null,"sha256":"<<sha2(cast(k as string), 256)>>","importedAt":"2024-01-01T00:00:00Z","parsingStatus":"success","parsingErrors":["w"]}'
CLIMB = (
    f'{{"id":"c<<k>>","routeId":"<<if(m = 10 and i = 0, "rx", concat("r", k))>>","name":null,"startDistanceKm":1,"endDistanceKm":{at(14, "0.5", "3")},"elevationGainM":200,"averageGradientPercent":6,"maxGradientPercent":null,'
    f'"startAltitudeM":null,"endAltitudeM":700,"confidence":"probable","provenance":<<if(m = 26 and i = 0, "null", \'{SOURCE}\')>>}}'
).replace('"rx"', "'rx'").replace('"r"', "'r'").replace('"null"', "'null'")
POINT = f'{{"id":"p<<k>>","routeId":"r<<k>>","type":"summit","name":"P","latitude":45,"longitude":6,"elevationM":null,"trackDistanceKm":2,"provenance":{SOURCE}}}'
WEATHER = (
    '{"id":"w<<k>>","dayId":"d<<if(m = 21 and i = 0 and n > 1, get(ks, i + 1), k)>>","routePointId":"p<<k>>","forDate":"<<date_add(date\'2024-01-01\', i)>>","forecastAt":null,"temperatureMinC":1,"temperatureMaxC":9,'
    f'"windSpeedKph":null,"precipitationMm":0,"weatherCode":3,"provenance":{SOURCE}}}'
)
PAUSES = '[{"id":"x","active":true,"routePointId":"p<<k>>","durationSeconds":600,"order":0,"origin":"custom"},' + f'{{"id":"y","active":false,"routePointId":null,"durationSeconds":0,"order":{at(24, "0", "1")},"origin":"automatic"}}]'
STAGE_SETTINGS = f'{{"stageId":"s<<k>>","pausePlanMode":null,"pauses":{PAUSES}}}'
DAY_SETTINGS = '{"dayId":"d<<k>>","departureTime":"08:30","totalBreakSeconds":null}'
PLACE = (
    '{"id":"q<<t>>","category":"water","name":null,"latitude":45,"longitude":6,"description":null,"trackDistanceKm":null,"detourKm":null,"openingHours":null,"hidden":false,"pinned":true,'
    f'"usefulTags":{{"fee":"no"}},"dayIds":["d<<k0>>"<<if(m = 15, concat(\',"d\', k0, \'"\'), \'\')>>],"provenance":{SOURCE}}}'
)
LODGING = f'{{"id":"a<<t>>","name":"Inn","type":"hotel","address":null,"mapsUrl":null,"website":null,"phone":null,"bookingReference":null,"notes":null,"latitude":null,"longitude":null,"confirmed":true,"provenance":{SOURCE}}}'
OVERRIDE = '{"id":"o<<t>>-0","targetType":"trip-day","targetId":"d<<k0>>","field":"notes","reason":null,"createdAt":"2024-01-02T00:00:00Z"}'
END = "<<if(m = 9, date'2023-12-01', date_add(date'2024-01-01', n - 1))>>"
ZONE = "<<if(m = 7, 'Mars/Base', 'Europe/Paris')>>"
DOCUMENT = (
    '{"schemaVersion":<<if(m = 1, 2, 1)>>,"metadata":{"id":"t<<t>>","slug":"<<if(m = 3, \'A b\', concat(\'trip-\', t))>>","name":"<<if(m = 2, \'\', \'Trip\')>>","description":null,"createdAt":"<<if(m = 4, \'x\', \'2024-01-01T00:00:00Z\')>>",'
    '"updatedAt":"<<if(m = 5, \'2023-01-01T00:00:00Z\', \'2024-01-02T00:00:00Z\')>>","startDate":"2024-01-01",' + f'"endDate":"{END}","timezone":"{ZONE}",'
    '"language":"fr","units":"<<if(m = 8, \'x\', \'metric\')>>","status":"ready","schemaVersion":1,"engineVersion":"e@1"},'
    f'"calendar":{{"startDate":"<<if(m = 6, \'2024-13-01\', \'2024-01-01\')>>","endDate":"{END}","timezone":"{ZONE}"}},'
    f'"sourceFiles":<<if(m = 11, \'7\', files)>>,"routes":<<routes>>,"climbs":<<climbs>>,"routePoints":<<points>>,"practicalPlaces":[{PLACE}],"accommodations":[{LODGING}<<if(m = 23, {filled("," + LODGING)}, \'\')>>],'
    '"days":<<days>>,"weather":<<weather>>,"stages":<<stages>>,"settings":{"global":{"referenceSpeedKph":18,"pausePlanMode":"automatic"},"days":<<day_settings>>,"stages":<<stage_settings>>},'
    f'"overrides":[{OVERRIDE}<<if(m = 25, {filled("," + OVERRIDE.replace("-0", "-1"))}, \'\')>>],'
    '"enrichmentMetadata":{"providers":[{"provider":"osm","lastAttemptedAt":null,"lastSuccessAt":null,"status":"success","message":null}]},"generatedMetadata":{"engineVersion":"e@1","generatedAt":null,"derivedDataStatus":"fresh"}}'
)
ITEMS = {
    "days": DAY, "stages": STAGE, "routes": ROUTE, "files": FILE, "climbs": CLIMB, "points": POINT, "weather": WEATHER, "day_settings": DAY_SETTINGS, "stage_settings": STAGE_SETTINGS,
}


def trip_texts(spark, sf_dir) -> DataFrame:
    """A customer's orders as the days of a trip, as one JSON document: trip_id, document (text)."""
    # a row of an order is small and its part of the document large: only the orders are gathered, in as many tasks as there are (their bytes would ask for few)
    o = table(spark, sf_dir, "orders").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_custkey")
    trips = o.groupBy(F.col("o_custkey").alias("t")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("ks"))
    trips = trips.selectExpr("t", f"t % {FAULTS} as m", "transform(ks, x -> x.o_orderkey) as ks").selectExpr("*", "size(ks) as n", "ks[0] as k0")
    made = trips.select("*", *(F.expr(f"concat('[', array_join(transform(ks, (k, i) -> {filled(item)}), ','), ']')").alias(name) for name, item in ITEMS.items()))
    return made.select(F.col("t").alias("trip_id"), F.expr(f"if(m = 27, '[]', {filled(DOCUMENT)})").alias("document"))


def trip_documents(spark, sf_dir) -> DataFrame:
    """The same as variants."""
    return trip_texts(spark, sf_dir).withColumn("document", F.try_parse_json("document"))


def bundle_issues(spark, sf_dir):
    return rules.document_issues(trip_texts(spark, sf_dir), rules.BUNDLE, "trip_id", "document").select("trip_id", "path", "code")


QUERIES = {"bundle_issues": bundle_issues}

#: fault, condition on n (days of the trip), path and code of every issue that it makes.
PLANTED = (
    (1, "", "schemaVersion", "unsupported-schema-version"), (1, "", "metadata.schemaVersion", "inconsistent-schema-version"), (2, "", "metadata.name", "missing-required"),
    (3, "", "metadata.slug", "invalid-value"), (4, "", "metadata.createdAt", "invalid-datetime"), (5, "", "metadata.updatedAt", "inconsistent-timestamps"),
    (6, "", "calendar.startDate", "invalid-date"), (6, "", "calendar.startDate", "missing-required"), (6, "", "metadata.startDate", "inconsistent-metadata-calendar"),
    (7, "", "metadata.timezone", "unknown-timezone"), (7, "", "calendar.timezone", "unknown-timezone"), (8, "", "metadata.units", "invalid-enum"),
    (9, "", "calendar.endDate", "inconsistent-date-range"), (9, "", "calendar.endDate", "inconsistent-duration"), (10, "", "climbs[0].routeId", "unknown-reference"),
    (10, "", "stages[0].climbIds[0]", "route-mismatch"), (11, "", "sourceFiles", "invalid-type"), (12, "", "routes[0].segments[1].index", "non-contiguous-index"),
    (13, "", "routes[0].profile.points[2].distanceKm", "non-increasing-distance"), (14, "", "climbs[0].endDistanceKm", "inconsistent-range"),
    (15, "", "practicalPlaces[0].dayIds[1]", "duplicate-reference"), (16, "", "days[0].date", "inconsistent-day-date"), (16, "", "weather[0].forDate", "inconsistent-day-date"),
    (17, "", "days[0].stageId", "unexpected-value"), (17, "", "stages[0].dayId", "invalid-reference"), (18, "", "stages[0].totalDurationSeconds", "inconsistent-duration"),
    (20, "", "days[0].index", "non-contiguous-index"), (20, "", "days[0].date", "inconsistent-day-date"), (21, "n > 1", "stages[0].weatherRecordIds[0]", "day-mismatch"),
    (21, "n > 1", "weather[0].forDate", "inconsistent-day-date"), (22, "n > 1", "stages", "duplicate-stage-for-day"), (22, "n > 1", "days[0].stageId", "inconsistent-relationship"),
    (22, "n > 1", "stages[0].weatherRecordIds[0]", "day-mismatch"), (23, "", "accommodations[1].id", "duplicate-id"), (24, "", "settings.stages[0].pauses[1].order", "duplicate-order"),
    (24, "", "settings.stages[0].pauses", "non-contiguous-order"), (25, "", "overrides[1]", "duplicate-override"), (26, "", "climbs[0].provenance", "invalid-provenance"), (27, "", "", "invalid-root"),
    (28, "", "routes[0].geometry.full[1]", "invalid-value"),
)
SQL = {
    "bundle_issues": "WITH t AS (SELECT o_custkey AS trip_id, o_custkey % 29 AS m, count(*) AS n FROM orders GROUP BY o_custkey) "
    + " UNION ALL ".join(f"SELECT trip_id, '{p}' AS path, '{c}' AS code FROM t WHERE m = {m}{' AND ' + w if w else ''}" for m, w, p, c in PLANTED)
    + " UNION ALL SELECT trip_id, 'days[' || i || '].date', 'inconsistent-calendar' FROM t, range(n) r(i) WHERE m = 6"
    + " UNION ALL SELECT trip_id, 'routes[' || i || '].sourceFileId', 'unknown-reference' FROM t, range(n) r(i) WHERE m = 11",
}
