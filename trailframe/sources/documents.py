"""JSON documents: forecasts with columns as arrays, place lists, feature collections; trip records in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOURLY = (
    "temperature_2m", "apparent_temperature", "relative_humidity_2m", "precipitation_probability", "precipitation", "rain", "showers", "snowfall", "weather_code", "cloud_cover",
    "visibility", "wind_speed_10m", "wind_direction_10m", "wind_gusts_10m", "freezing_level_height",
)
FORECAST = "latitude double, longitude double, location_id int, timezone string, hourly struct<time: array<string>, " + ", ".join(f"{v}: array<double>" for v in HOURLY) + ">"


def forecast_rows(payloads: DataFrame) -> DataFrame:
    """payloads: request, json (an array of places) -> one row an hour; places whose arrays don't fit give none."""
    places = payloads.select("request", F.inline(F.from_json("json", f"array<struct<{', '.join(p.replace(' ', ': ', 1) for p in split_fields(FORECAST))}>>")))
    n = F.size("hourly.time")
    fits = n > 0
    for v in HOURLY:
        fits = fits & (F.col(f"hourly.{v}").isNull() | (F.size(f"hourly.{v}") == n))
    rising = F.expr("forall(sequence(1, greatest(1, size(hourly.time) - 1)), i -> size(hourly.time) < 2 or hourly.time[i] > hourly.time[i - 1])")
    rows = places.where(fits & rising).select("request", F.coalesce("location_id", F.lit(0)).alias("location_id"), F.posexplode("hourly.time").alias("k", "_time"), "hourly")
    values = [F.get(F.col(f"hourly.{v}"), F.col("k")).alias(v) for v in HOURLY]
    return rows.select("request", "location_id", F.col("_time").try_cast("timestamp_ntz").alias("time"), *values)


def forecast_status(payloads: DataFrame, expected: Column) -> DataFrame:
    """success, partial or error by how many of the expected places came with hours, and the dates covered."""
    rows = forecast_rows(payloads)
    got = rows.groupBy("request").agg(F.count_distinct("location_id").alias("places"), F.array_sort(F.collect_set(F.date_format("time", "yyyy-MM-dd"))).alias("dates"))
    all_ = payloads.select("request", expected.alias("expected")).join(got, "request", "left").fillna(0, ["places"])
    status = F.when(F.col("places") == 0, "error").when(F.col("places") < F.col("expected"), "partial").otherwise("success")
    return all_.withColumn("status", status)


def split_fields(ddl: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def features(documents: DataFrame) -> DataFrame:
    """documents: json of GeoJSON collections -> point features with name, elevation (a number before any unit) and tags."""
    schema = "features array<struct<id: string, geometry: struct<type: string, coordinates: array<double>>, properties: map<string, string>>>"
    rows = documents.select(F.inline(F.from_json("json", schema)["features"]))
    elevation = F.regexp_replace(F.regexp_replace(F.element_at("properties", F.lit("ele")), r"\s", ""), ",", ".")
    return rows.where("geometry.type = 'Point' and size(geometry.coordinates) >= 2").select(
        "id", F.col("geometry.coordinates")[1].alias("latitude"), F.col("geometry.coordinates")[0].alias("longitude"), F.element_at("properties", F.lit("name")).alias("name"),
        F.regexp_extract(elevation, r"^(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double").alias("elevation_m"), F.col("properties").alias("tags"),
    )


# Tags that are kept of a map feature, and shops that count as supermarkets.
USEFUL_TAGS = (
    "amenity", "shop", "opening_hours", "access", "fee", "drinking_water", "operator", "brand", "cuisine", "wheelchair", "toilets:wheelchair", "self_service",
    "service:bicycle:repair", "service:bicycle:pump", "phone", "contact:phone", "website", "contact:website",
)
SUPERMARKETS = ("supermarket", "convenience", "grocery", "greengrocer", "deli")


def place_category(tags: Column) -> Column:
    """Category of a place from its map tags, null for what is no practical place."""
    amenity, shop = (F.element_at(tags, F.lit(k)) for k in ("amenity", "shop"))
    return (
        F.when(amenity == "drinking_water", "water").when(amenity == "toilets", "toilet").when((amenity == "bicycle_repair_station") | (shop == "bicycle"), "bike-service")
        .when(amenity == "shelter", "shelter").when(shop == "bakery", "bakery").when(amenity.isin("restaurant", "fast_food"), "fast-food")
        .when(shop == "sports", "sports").when(shop.isin(*SUPERMARKETS), "supermarket")
    )


def useful_tags(tags: Column) -> Column:
    """The tags that say something to a rider, trimmed, without the empty ones."""
    trimmed = F.transform_values(F.map_filter(tags, lambda k, v: k.isin(*USEFUL_TAGS)), lambda k, v: F.trim(v))
    return F.map_filter(trimmed, lambda k, v: v != "")


def place_name(tags: Column, language: str) -> Column:
    """Name in the language, else the name, else the brand; blank ones don't count."""
    return F.coalesce(*[F.nullif(F.trim(F.element_at(tags, F.lit(k))), F.lit("")) for k in (f"name:{language}", "name", "brand")])


def explode_records(bundles: DataFrame, key: str, items: str) -> DataFrame:
    """Array items as rows with their ordinal."""
    return bundles.select(F.col(key), F.posexplode(items).alias("ordinal", "item"))


def collect_records(rows: DataFrame, key: str, to: str) -> DataFrame:
    """The inverse: arrays in the order of the ordinals."""
    sorted_ = F.array_sort(F.collect_list(F.struct("ordinal", "item")))
    return rows.groupBy(key).agg(F.transform(sorted_, lambda x: x["item"]).alias(to))


def save_version(spark: SparkSession, root: str, trip_id: str, tables: dict[str, DataFrame], version: int) -> None:
    """Write all tables of a trip under a new version, then its manifest row: readers see all of it or nothing.

    A version that was written only in part has no manifest row and is never read.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/data/trip={trip_id}/version={version}/{name}")
    row = spark.createDataFrame([(trip_id, version, sorted(tables))], "trip_id string, version int, tables array<string>")
    row.coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def current_versions(spark: SparkSession, root: str) -> DataFrame:
    manifest = spark.read.parquet(f"{root}/manifest")
    return manifest.groupBy("trip_id").agg(F.max("version").alias("version"), F.max_by("tables", "version").alias("tables")).where(F.size("tables") > 0)


def load_table(spark: SparkSession, root: str, trip_id: str, name: str) -> DataFrame:
    """A table of the trip's current version."""
    row = current_versions(spark, root).where(F.col("trip_id") == trip_id).first()
    if row is None or name not in row.tables:
        raise ValueError(f"no table {name} of trip {trip_id}")
    return spark.read.parquet(f"{root}/data/trip={trip_id}/version={row.version}/{name}")


def nearest_cached(points: DataFrame, cache: DataFrame, radius_m: float) -> DataFrame:
    """Cached answers within the radius of each point: the nearest, ties to the newest; a grid equi-join finds them."""
    from trailframe.functions.geo import equirectangular_m
    from trailframe.operators.spatial import cells

    rows, columns, r, c = cells(radius_m, "latitude", "longitude")
    left = points.select("point_id", "latitude", "longitude", r.alias("_r"), c.alias("_c"))
    right = cache.withColumn("_r", rows).withColumn("_c", columns).select(F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), "answer", "fetched_at", "_r", "_c")
    far = equirectangular_m(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon"))
    near = left.join(right, ["_r", "_c"]).withColumn("far", far).where(F.col("far") <= radius_m)
    w = Window.partitionBy("point_id").orderBy("far", F.desc("fetched_at"), "answer")
    return near.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("point_id", "answer", "far")


def trimmed_cache(cache: DataFrame, entries: int = 24, chars: int = 2_800_000) -> DataFrame:
    """The newest entries of each owner, as many as the limits on number and size let stay."""
    w = Window.partitionBy("owner").orderBy(F.desc("fetched_at"), "request")
    sized = cache.withColumn("_n", F.row_number().over(w)).withColumn("_chars", F.sum(F.length("payload")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return sized.where((F.col("_n") <= entries) & (F.col("_chars") <= chars)).drop("_n", "_chars")
