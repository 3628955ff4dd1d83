"""Track files (GPX 1.0 and 1.1): whole files in, ordered points, named points and issues out.

A file is one row, so files are read in parallel and parsed in the JVM by
from_xml; namespaces are ignored, so prefixed tags read alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.functions.geo import valid_coordinate

POINT = "struct<_lat: string, _lon: string, ele: string, time: string, name: string, desc: string, sym: string>"
SCHEMA = (
    f"metadata struct<name: string>, trk array<struct<name: string, trkseg array<struct<trkpt: array<{POINT}>>>>>, rte array<struct<name: string, rtept: array<{POINT}>>>, "
    f"wpt array<{POINT}>, _corrupt_record string"
).replace("trkseg array", "trkseg: array")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file_name, size, sha256 and xml of each .gpx file under a path that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gpx").load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("xml")
    )


def file_number(name: Column) -> Column:
    """The leading number of a file name, null if there is none."""
    return F.regexp_extract(name, r"^\D*(\d+)", 1).try_cast("int")


def admission_issues(files: DataFrame) -> DataFrame:
    """Files that are refused before they are parsed: wrong extension, empty, or no name."""
    name = F.trim(F.coalesce("file_name", F.lit("")))
    code = F.when(name == "", "missing-name").when(~F.lower(name).endswith(".gpx"), "wrong-extension").when(F.col("size") == 0, "empty-file")
    return files.select("file_name", code.alias("code")).where("code is not null")


def structure_counts(files: DataFrame) -> DataFrame:
    """file_name and how many waypoints, route points, and name, desc, sym and extensions elements a file has, whatever their prefixes."""
    count = lambda tag: F.regexp_count("xml", F.lit(rf"<(?:[A-Za-z_][\w.-]*:)?{tag}[\s/>]")).alias(f"{tag}_count")
    return files.select("file_name", *[count(t) for t in ("wpt", "rtept", "name", "desc", "sym", "extensions")])


def parsed(files: DataFrame) -> DataFrame:
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return files.withColumn("gpx", F.from_xml("xml", SCHEMA, options))


def number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def track_points(files: DataFrame) -> DataFrame:
    """file_name, segment_index, seq (through the file), latitude, longitude, elevation_m, time, valid.

    Routes stand in where a file has no track.  Bad coordinates are marked, so that
    a strict reader refuses the file and a tolerant one drops the point.
    """
    docs = parsed(files)
    tracks = docs.select("file_name", F.posexplode(F.expr("flatten(transform(gpx.trk, t -> t.trkseg))")).alias("segment_index", "s"))
    tracked = tracks.select("file_name", "segment_index", F.posexplode("s.trkpt").alias("k", "p"))
    routes = docs.where("coalesce(size(flatten(transform(gpx.trk, t -> t.trkseg))), 0) <= 0").select("file_name", F.posexplode("gpx.rte").alias("segment_index", "s"))
    routed = routes.select("file_name", "segment_index", F.posexplode("s.rtept").alias("k", "p"))
    points = tracked.unionByName(routed)
    lat, lon = number(F.col("p._lat")), number(F.col("p._lon"))
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("file_name").orderBy("segment_index", "k")) - 1
    return points.select(
        "file_name", "segment_index", seq.alias("seq"), lat.alias("latitude"), lon.alias("longitude"), number(F.col("p.ele")).alias("elevation_m"),
        F.col("p.time").try_cast("timestamp").alias("time"), valid_coordinate(lat, lon).alias("valid"),
    )


def named_points(files: DataFrame) -> DataFrame:
    """Waypoints with a usable place."""
    rows = parsed(files).select("file_name", F.posexplode("gpx.wpt").alias("k", "p"))
    lat, lon = number(F.col("p._lat")), number(F.col("p._lon"))
    points = rows.select("file_name", "k", F.nullif(F.trim("p.name"), F.lit("")).alias("name"), F.col("p.desc").alias("description"), lat.alias("latitude"), lon.alias("longitude"), number(F.col("p.ele")).alias("elevation_m"))
    return points.where(valid_coordinate(F.col("latitude"), F.col("longitude")))


def file_issues(files: DataFrame) -> DataFrame:
    """Why a file can't be used (invalid-xml, no-points) or what was dropped from it (invalid-coordinates)."""
    docs = parsed(files).select("file_name", ((F.col("gpx").isNull()) | F.col("gpx._corrupt_record").isNotNull()).alias("broken"))
    counts = track_points(files).groupBy("file_name").agg(F.count_if("valid").alias("good"), F.count_if(~F.col("valid")).alias("bad"))
    rows = docs.join(counts, "file_name", "left").fillna(0, ["good", "bad"])
    codes = F.array_compact(
        F.array(F.when(F.col("broken"), "invalid-xml"), F.when(~F.col("broken") & (F.col("good") < 2), "no-points"), F.when(F.col("bad") > 0, "invalid-coordinates"))
    )
    return rows.select("file_name", F.explode(codes).alias("code"))
