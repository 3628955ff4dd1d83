"""Weather codes, exposure, hazard rules and display modes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Weather code, severity.
CODE_SEVERITY = (
    (0, 0), (1, 1), (2, 2), (3, 3), (45, 5), (48, 6), (51, 4), (53, 5), (55, 6), (56, 7), (57, 8), (61, 5), (63, 6), (65, 8), (66, 8),
    (67, 9), (71, 6), (73, 7), (75, 9), (77, 6), (80, 6), (81, 7), (82, 9), (85, 7), (86, 9), (95, 10), (96, 11), (99, 12),
)
# Weather code, its name as shown (French), and what is shown for any other.
CODE_LABELS = {
    0: "Ciel dégagé", 1: "Plutôt dégagé", 2: "Partiellement nuageux", 3: "Couvert", 45: "Brouillard",
    48: "Brouillard givrant", 51: "Bruine faible", 53: "Bruine modérée", 55: "Bruine forte", 56: "Bruine verglaçante faible",
    57: "Bruine verglaçante forte", 61: "Pluie faible", 63: "Pluie modérée", 65: "Pluie forte", 66: "Pluie verglaçante faible",
    67: "Pluie verglaçante forte", 71: "Neige faible", 73: "Neige modérée", 75: "Neige forte", 77: "Grains de neige",
    80: "Averses faibles", 81: "Averses modérées", 82: "Averses violentes", 85: "Averses de neige faibles", 86: "Averses de neige fortes",
    95: "Orage", 96: "Orage avec grêle faible", 99: "Orage avec forte grêle",
}
NO_LABEL = "Conditions non identifiées"
# Thresholds of the hazards, orange then red.
PRECIPITATION_MM, PRECIPITATION_PCT, PRECIPITATION_WITH_PCT_MM = (1.5, 4.0), (60, 80), (0.5, 2.0)
STORM_CODES = ((95,), (96, 99))
WIND_KPH, GUST_KPH, EXPOSED_GUST_KPH = (35, 50), (50, 70), (45, 65)
COLD_C, EXPOSED_COLD_C, HEAT_C = (3, -2), (5, 0), (30, 35)
VISIBILITY_M, FREEZING_MARGIN_M, SNOW_CM = (5000, 1000), (300, 0), (0, 1)
HIGH_ALTITUDE_M = 1500
ESSENTIAL = ("start", "end", "col", "summit", "passage")
# Order in which the hazards of one point are reported.
HAZARDS = ("precipitation", "thunderstorm", "snow", "cold", "heat", "wind", "gust", "visibility", "freezing-level")


def code_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CODE_SEVERITY), "weather_code int, severity int")


def severity(code: Column) -> Column:
    """-1 for codes that aren't known, null for none."""
    known = F.create_map(*[F.lit(x) for pair in CODE_SEVERITY for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.element_at(known, code), F.lit(-1)))


def label(code: Column) -> Column:
    """The name of a weather code; one name for none and for those that aren't known."""
    known = F.create_map(*[F.lit(x) for pair in CODE_LABELS.items() for x in pair])
    return F.coalesce(F.element_at(known, code), F.lit(NO_LABEL))


def worst_code(code: Column) -> Column:
    """Aggregate: the code of the greatest severity, ties to the larger code."""
    return F.max(F.when(code.isNotNull(), F.struct(severity(code).alias("severity"), code.alias("code"))))["code"]


def exposed(kind: Column, elevation_m: Column, strategic: Column) -> Column:
    return kind.isin("col", "summit") | (elevation_m >= HIGH_ALTITUDE_M) | F.coalesce(strategic, F.lit(False))


def level(red: Column, orange: Column) -> Column:
    """red before orange; unknown conditions count as not met."""
    return F.when(F.coalesce(red, F.lit(False)), "red").when(F.coalesce(orange, F.lit(False)), "orange")


def hazard_levels(elevation_m: Column, is_exposed: Column) -> dict[str, Column]:
    """Level (or null) of the hazards that rest on no other one, by name."""
    mm, pct, code = F.col("precipitation_mm"), F.col("precipitation_pct"), F.col("weather_code")
    rain = [(mm >= PRECIPITATION_MM[i]) | (F.coalesce(pct >= PRECIPITATION_PCT[i], F.lit(False)) & (mm >= PRECIPITATION_WITH_PCT_MM[i])) for i in (1, 0)]
    pick = lambda exposed_pair, pair, i: F.when(is_exposed, F.lit(exposed_pair[i])).otherwise(F.lit(pair[i]))
    gust, cold = F.col("gust_kph"), F.col("apparent_c")
    return {
        "precipitation": level(*rain),
        "thunderstorm": level(code.isin(*STORM_CODES[1]), code.isin(*STORM_CODES[0])),
        "cold": level(cold <= pick(EXPOSED_COLD_C, COLD_C, 1), cold <= pick(EXPOSED_COLD_C, COLD_C, 0)),
        "heat": level(cold >= HEAT_C[1], cold >= HEAT_C[0]),
        "wind": level(F.col("wind_kph") >= WIND_KPH[1], F.col("wind_kph") >= WIND_KPH[0]),
        "gust": level(gust >= pick(EXPOSED_GUST_KPH, GUST_KPH, 1), gust >= pick(EXPOSED_GUST_KPH, GUST_KPH, 0)),
        "visibility": level(F.col("visibility_m") < VISIBILITY_M[1], F.col("visibility_m") < VISIBILITY_M[0]),
    }


def add_hazards(points: DataFrame, elevation: str = "elevation_m", exposure: str = "exposed") -> DataFrame:
    """Add a column of each hazard's level, then `findings`: array of struct(rank, risk, level, value) in the fixed order."""
    own = hazard_levels(F.col(elevation), F.col(exposure))
    name = lambda risk: "_" + risk.replace("-", "_")
    rows = points.withColumns({name(k): v for k, v in own.items()})
    snow, margin = F.col("snowfall_cm"), F.col("freezing_m") - F.col(elevation)
    windy = F.col("_wind").isNotNull() | F.col("_gust").isNotNull()
    heavy = (snow >= SNOW_CM[1]) | (F.col(exposure) & windy & F.col("_cold").isNotNull())
    icy = (margin <= FREEZING_MARGIN_M[1]) | (F.col(exposure) & F.col("_precipitation").isNotNull() & F.col("_cold").isNotNull())
    rows = rows.withColumn("_snow", F.when(snow > SNOW_CM[0], level(heavy, F.lit(True))))
    rows = rows.withColumn("_freezing_level", F.when(margin <= FREEZING_MARGIN_M[0], level(icy, F.lit(True))))
    value = {
        "precipitation": "precipitation_mm", "snow": "snowfall_cm", "cold": "apparent_c", "heat": "apparent_c", "wind": "wind_kph", "gust": "gust_kph",
        "visibility": "visibility_m", "freezing-level": "freezing_m",
    }
    each = [
        F.struct(F.lit(i).alias("rank"), F.lit(k).alias("risk"), F.col(name(k)).alias("level"), (F.col(value[k]) if k in value else F.lit(None)).cast("double").alias("value"))
        for i, k in enumerate(HAZARDS)
    ]
    return rows.withColumn("findings", F.filter(F.array(*each), lambda x: x["level"].isNotNull())).drop(*[name(k) for k in HAZARDS])


#: How many days ahead a forecast is operational, and good for planning.
OPERATIONAL_DAYS, PLANNING_DAYS = 2, 7


def display_mode(date: Column, today: Column, covered_from: Column, covered_to: Column) -> Column:
    """How a day's forecast is shown: past, live (today), today-reference (no forecast covers the day), operational, planning, trend.

    Coverage goes before the bands, so a near day that the answer lacks is no operational one.
    """
    ahead = F.datediff(date, today)
    covered = F.coalesce((date >= covered_from) & (date <= covered_to), F.lit(False))
    return (
        F.when(ahead < 0, "past").when(ahead == 0, "live").when(~covered, "today-reference")
        .when(ahead <= OPERATIONAL_DAYS, "operational").when(ahead <= PLANNING_DAYS, "planning").otherwise("trend")
    )
