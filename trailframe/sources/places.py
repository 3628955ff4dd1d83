"""Places from map exports and gazetteers: KML layers, accommodations, short names of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "struct<name: string, description: string, styleUrl: string, Point: struct<coordinates: string>>"
FOLDER = f"struct<name: string, Placemark: array<{MARK}>>"
KML = f"Document struct<name: string, Folder: array<{FOLDER}>, Placemark: array<{MARK}>>"
#: Name of the layer of points that stand in no folder (French, as shown), and the longest description. Fixed values.
NO_LAYER, LONGEST = "Sans calque", 280
#: Parts of an address that name a place, the first one that is there. Fixed values.
LOCALITIES = ("city", "town", "village", "municipality", "hamlet", "suburb", "neighbourhood")
AREAS = ("county", "country")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain_text(html: Column) -> Column:
    """Text of an HTML fragment, a line for each break, without scripts, styles and tags."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?i)<(br|/p|/div|/li)\b[^>]*>", "\n")
    return F.regexp_replace(text, "<[^>]*>", " ")


def description(html: Column, name: Column, layer: Column) -> Column:
    """The lines of a description that say something new, joined by middle dots; null if there is none.

    Lines that repeat the point's name, its layer or an earlier line are left out,
    whatever their case.
    """
    lines = F.filter(F.transform(F.split(plain_text(html), r"\r?\n"), one_line), lambda x: x != "")
    said = F.array(F.lower(name), F.lower(layer))
    fresh = F.filter(lines, lambda x, i: ~F.array_contains(said, F.lower(x)) & (F.array_position(F.transform(lines, lambda y: F.lower(y)), F.lower(x)) == i + 1))
    return F.nullif(F.substring(F.array_join(fresh, " · "), 1, LONGEST), F.lit(""))


def kml_points(files: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """files(file_name, xml) -> file_name, layer, name, description, style, latitude, longitude, elevation_m of placemarks with a point.

    Points in folders whose name is excluded (in any case) are left out, and so are
    those without usable coordinates.
    """
    rows = files.withColumn("_k", F.from_xml("xml", KML, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}))
    loose = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("_k.Document.Placemark").alias("Placemark")))
    folders = rows.select("file_name", F.explode(F.concat(F.coalesce("_k.Document.Folder", F.expr(f"cast(array() as array<{FOLDER}>)")), loose)).alias("f"))
    layer = F.coalesce(F.nullif(one_line(F.col("f.name")), F.lit("")), F.lit(NO_LAYER))
    marks = folders.select("file_name", layer.alias("layer"), F.explode("f.Placemark").alias("m")).where(~F.lower("layer").isin(*[x.lower() for x in excluded]) if excluded else F.lit(True))
    at = F.split(F.trim(F.element_at(F.split(F.trim("m.Point.coordinates"), r"\s+"), 1)), ",")
    name = F.coalesce(F.nullif(one_line(F.regexp_replace("m.name", "<[^>]*>", " ")), F.lit("")), F.col("layer"))
    points = marks.where("m.Point.coordinates is not null").select(
        "file_name", "layer", name.alias("name"), description(F.coalesce("m.description", F.lit("")), name, F.col("layer")).alias("description"), F.col("m.styleUrl").alias("style"),
        F.get(at, 1).try_cast("double").alias("latitude"), F.get(at, 0).try_cast("double").alias("longitude"), F.get(at, 2).try_cast("double").alias("elevation_m"),
    )
    return points.where("abs(latitude) <= 90 and abs(longitude) <= 180")


def accommodations(documents: DataFrame, version: int = 1) -> DataFrame:
    """documents(json) of that version -> a row for each accommodation and day; documents of others give none."""
    item = "struct<id: string, name: string, type: string, address: string, website: string, latitude: double, longitude: double, dayIds: array<string>>"
    rows = documents.select(F.from_json("json", f"version int, tripId string, accommodations array<{item}>").alias("d")).where(F.col("d.version") == version)
    return rows.select(F.col("d.tripId").alias("trip_id"), F.explode("d.accommodations").alias("a")).select(
        "trip_id", "a.id", "a.name", "a.type", "a.address", "a.website", "a.latitude", "a.longitude", F.explode("a.dayIds").alias("day_id")
    )


def short_place_name(address: Column, name: Column, display_name: Column) -> Column:
    """A short label of an address (a map): its locality, else road and area, the road, the name, the area, or two parts of the long name."""

    def first(keys: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.element_at(address, F.lit(k))), F.lit("")) for k in keys])

    road, area = first(("road",)), first(AREAS)
    both = F.when(road.isNotNull() & area.isNotNull() & (road != area), F.concat(road, F.lit(", "), area))
    parts = F.filter(F.transform(F.split(display_name, ","), lambda x: F.trim(x)), lambda x: x != "")
    long = F.nullif(F.array_join(F.slice(parts, 1, 2), ", "), F.lit(""))
    return F.coalesce(first(LOCALITIES), both, road, F.nullif(F.trim(name), F.lit("")), area, long)
