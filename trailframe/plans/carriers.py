"""The driver's tables seen as tracks, forecasts and trips, for queries and for SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user are the points of a route; every 40 points begin a segment, five routes make a chain."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    missing = (F.col("event_type") == "error") | ((F.col("user_id") % 10 == 0) & (F.col("event_type") != "click"))
    return events.withColumn("seq", seq).select(
        F.col("user_id").alias("route_id"),
        "seq",
        (F.lit(45.0) + F.col("user_id") * 0.01 + F.col("seq") * 0.0003).alias("latitude"),
        (F.lit(6.0) + (F.col("event_id") % 97) * 1e-6 + F.col("seq") * 0.0003).alias("longitude"),
        F.when(~missing, F.lit(800.0) + F.sin(F.col("seq") / 15) * 60 + F.col("value") * 0.02).alias("elevation_m"),
        "ts",
        F.floor(F.col("seq") / 40).cast("int").alias("segment_index"),
        F.floor(F.col("user_id") / 5).cast("int").alias("chain"),
    )


POINTS_SQL = """track_points AS (
    SELECT user_id AS route_id, seq, 45.0::DOUBLE + user_id * 0.01::DOUBLE + seq * 0.0003::DOUBLE AS latitude,
        6.0::DOUBLE + (event_id % 97) * 1e-6::DOUBLE + seq * 0.0003::DOUBLE AS longitude,
        CASE WHEN event_type = 'error' OR (user_id % 10 = 0 AND event_type <> 'click') THEN NULL
            ELSE 800.0::DOUBLE + sin(seq / 15.0::DOUBLE) * 60 + value * 0.02::DOUBLE END AS elevation_m,
        ts, CAST(seq // 40 AS INT) AS segment_index, CAST(user_id // 5 AS INT) AS chain
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events))"""


def hav(a: str, b: str, c: str, d: str) -> str:
    """DuckDB: great-circle kilometres between (a, b) and (c, d)."""
    h = f"(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2))"
    return f"(2 * 6371.0088::DOUBLE * atan2(sqrt({h}), sqrt(1.0 - {h})))"


STEPS_SQL = f"""{POINTS_SQL}, steps AS (
    SELECT *, coalesce({hav("lag(latitude) OVER w", "lag(longitude) OVER w", "latitude", "longitude")}, 0.0::DOUBLE) AS step_km,
        elevation_m - last_value(elevation_m IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up
    FROM track_points WINDOW w AS (PARTITION BY route_id ORDER BY seq)
), series AS (SELECT *, sum(step_km) OVER (PARTITION BY route_id ORDER BY seq) AS distance_km FROM steps)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by place (25) and hour, as an hourly forecast; some variables are missing in places."""
    events = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    base = events.groupBy((F.col("user_id") % 25).cast("int").alias("location_id"), hour.alias("time")).agg(
        F.round(F.avg("value"), 4).alias("v"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")
    )
    v, n = F.col("v"), F.col("n")
    return base.select(
        "location_id",
        "time",
        F.round(v * 0.08 - 4, 8).alias("apparent_c"),
        F.when(F.col("errors") == 0, F.round(v * 0.011, 8)).alias("precipitation_mm"),
        F.when(n % 4 != 0, F.round(v * 0.2, 8)).alias("precipitation_pct"),
        F.round(F.greatest(F.lit(0.0), v * 0.005 - 1.6), 8).alias("snowfall_cm"),
        F.when(n % 5 != 0, F.element_at(F.array(*[F.lit(x) for x in (0, 3, 45, 61, 65, 80, 95, 96, 7)]), (F.floor(v).cast("int") % 9) + 1)).alias("weather_code"),
        F.round(v * 0.11, 8).alias("wind_kph"),
        F.when(n % 3 != 0, F.round(v * 0.16, 8)).alias("gust_kph"),
        F.round(F.lit(12_000.0) - v * 23, 8).alias("visibility_m"),
        F.round(F.lit(600.0) + v * 5, 8).alias("freezing_m"),
    )


HOURLY_SQL = """hourly AS (
    SELECT location_id, time, round(v * 0.08::DOUBLE - 4, 8) AS apparent_c, CASE WHEN errors = 0 THEN round(v * 0.011::DOUBLE, 8) END AS precipitation_mm,
        CASE WHEN n % 4 <> 0 THEN round(v * 0.2::DOUBLE, 8) END AS precipitation_pct, round(greatest(0.0::DOUBLE, v * 0.005::DOUBLE - 1.6::DOUBLE), 8) AS snowfall_cm,
        CASE WHEN n % 5 <> 0 THEN [0, 3, 45, 61, 65, 80, 95, 96, 7][CAST(floor(v) AS INT) % 9 + 1] END AS weather_code,
        round(v * 0.11::DOUBLE, 8) AS wind_kph, CASE WHEN n % 3 <> 0 THEN round(v * 0.16::DOUBLE, 8) END AS gust_kph,
        round(12000.0::DOUBLE - v * 23, 8) AS visibility_m, round(600.0::DOUBLE + v * 5, 8) AS freezing_m
    FROM (SELECT CAST(user_id % 25 AS INT) AS location_id, date_trunc('hour', ts) AS time, round(avg(value), 4) AS v, count(*) AS n,
        count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2))"""


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as timed points of a day: a customer's orders are a day's stops, so days grow in number with the data."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    kinds = F.create_map(*[F.lit(x) for x in ("1-URGENT", "col", "2-HIGH", "start", "3-MEDIUM", "end", "4-NOT SPECIFIED", "passage", "5-LOW", "poi")])
    return orders.select(
        F.col("o_orderkey").alias("point_id"),
        (F.col("o_custkey") % 25).cast("int").alias("location_id"),
        F.col("o_custkey").cast("int").alias("day_id"),
        F.lit("2024-01-01").cast("date").alias("date"),
        F.timestamp_add("MINUTE", (F.col("o_orderkey") % 43_200).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("eta"),
        F.round(F.col("o_totalprice") % 3000, 2).alias("elevation_m"),
        F.coalesce(kinds[F.col("o_orderpriority")], F.lit("poi")).alias("kind"),
        (F.col("o_orderstatus") == "F").alias("strategic"),
    )


STOPS_SQL = """stops AS (
    SELECT o_orderkey AS point_id, CAST(o_custkey % 25 AS INT) AS location_id, CAST(o_custkey AS INT) AS day_id, DATE '2024-01-01' AS date,
        TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey % 43200 AS INT)) AS eta, round(o_totalprice % 3000, 2) AS elevation_m,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'col' WHEN '2-HIGH' THEN 'start' WHEN '3-MEDIUM' THEN 'end' WHEN '4-NOT SPECIFIED' THEN 'passage' ELSE 'poi' END AS kind,
        o_orderstatus = 'F' AS strategic FROM orders)"""
