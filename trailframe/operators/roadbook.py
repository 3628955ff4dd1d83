"""Documented points of a trip: editorial resolutions, suppressions, and the summary of their match with the tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of a match and editorial resolutions that the summary counts. Fixed values.
STATUSES = ("matched", "needs-review", "unmatched")
RESOLUTIONS = ("matched", "informational", "excluded", "user-decision-required")


def resolved(points: DataFrame, entries: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Points (point_id, name, status) with their resolution, without the suppressed ones (point_id).

    entries: point_id, resolution, justification, display_name.  A point without an
    entry is matched if the match says so; else someone has to decide, and it is
    never left out silently.  Both tables are small lists kept by hand; Spark
    broadcasts them by their measured size.
    """
    known = entries.select(F.col("point_id").alias("_id"), F.col("resolution").alias("_r"), F.col("justification").alias("_j"), F.col("display_name").alias("_n"))
    kept = points.join(suppressed.select("point_id"), "point_id", "left_anti").join(known, F.col("point_id") == F.col("_id"), "left")
    default = F.when(F.col("status") == "matched", "matched").otherwise("user-decision-required")
    named = kept.withColumn("name", F.coalesce("_n", "name")).withColumn("resolution", F.coalesce("_r", default))
    return named.withColumn("justification", F.col("_j")).drop("_id", "_r", "_j", "_n")


def match_summary(days: DataFrame, points: DataFrame, links: DataFrame, trip: str = "trip_id") -> DataFrame:
    """One row a trip: counts of days (kind, status), of points (status, resolution, kind) and of links."""
    of_days = days.groupBy(trip).agg(
        F.count("*").alias("days"), F.count_if(F.col("kind") == "ride").alias("rides"), F.count_if(F.col("kind") == "off").alias("offs"),
        F.count_if((F.col("kind") == "ride") & (F.col("status") == "ready")).alias("ready"), F.count_if((F.col("kind") == "ride") & (F.col("status") == "unavailable")).alias("unavailable"),
    )
    name = lambda kind, value: f"{kind}_{value.replace('-', '_')}"
    of_points = points.groupBy(trip).agg(
        F.count("*").alias("points"), *[F.count_if(F.col("status") == s).alias(name("status", s)) for s in STATUSES],
        *[F.count_if(F.col("resolution") == r).alias(name("resolution", r)) for r in RESOLUTIONS], F.count_if((F.col("kind") == "pause") & (F.col("status") == "matched")).alias("matched_pauses"),
    )
    rows = of_days.join(of_points, trip, "left").join(links.groupBy(trip).agg(F.count("*").alias("links")), trip, "left")
    return rows.fillna(0)


def summary_issues(summary: DataFrame, key: str = "trip_id") -> DataFrame:
    """Trips whose counts don't add up: the states of all points, and the resolutions of all points."""
    total = lambda kind, names: sum((F.col(f"{kind}_{n.replace('-', '_')}") for n in names[1:]), F.col(f"{kind}_{names[0].replace('-', '_')}"))
    codes = F.array_compact(F.array(
        F.when(total("status", STATUSES) != F.col("points"), "status-count"), F.when(total("resolution", RESOLUTIONS) != F.col("points"), "resolution-count"),
        F.when(F.col("rides") + F.col("offs") > F.col("days"), "day-count"),
    ))
    return summary.select(F.col(key).cast("string").alias("id"), F.explode(codes).alias("code"))
