"""Position fixes as a stream: sessions of a rider, distance per session, late data by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(fixes: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Rides as session windows: fixes (rider_id, ts, speed_kph) without a longer gap.  Works on streams and on tables."""
    rows = fixes.withWatermark("ts", late) if fixes.isStreaming else fixes
    grouped = rows.groupBy("rider_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("fixes"), F.max("speed_kph").alias("fastest"))
    return grouped.select("rider_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "fixes", "fastest")


def latest_forecast(updates: DataFrame, late: str = "1 hour") -> DataFrame:
    """One update a request and hour: repeated deliveries within the watermark drop out."""
    rows = updates.withWatermark("fetched_at", late) if updates.isStreaming else updates
    return rows.dropDuplicatesWithinWatermark(["request", "fetched_at"]) if updates.isStreaming else rows.dropDuplicates(["request", "fetched_at"])
