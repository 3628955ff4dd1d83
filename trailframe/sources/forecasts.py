"""Answers of the forecast service: places aligned to what was asked, units and columns checked, hours and days as rows.

Payloads are VARIANT, as an answer may be anything: an object for one place, an
array for several, an error, or columns of other lengths than their times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.operators.rules import let

#: Variables of hours and days with their units (in lower case).
HOURLY_UNITS = {
    "temperature_2m": "°c", "apparent_temperature": "°c", "relative_humidity_2m": "%", "precipitation_probability": "%", "precipitation": "mm", "rain": "mm", "showers": "mm", "snowfall": "cm",
    "weather_code": "wmo code", "cloud_cover": "%", "visibility": "m", "wind_speed_10m": "km/h", "wind_direction_10m": "°", "wind_gusts_10m": "km/h", "freezing_level_height": "m",
}
DAILY_UNITS = {
    "temperature_2m_min": "°c", "temperature_2m_max": "°c", "apparent_temperature_min": "°c", "apparent_temperature_max": "°c", "precipitation_sum": "mm", "precipitation_probability_max": "%",
    "weather_code": "wmo code", "wind_speed_10m_max": "km/h", "wind_gusts_10m_max": "km/h", "wind_direction_10m_dominant": "°", "sunrise": "iso8601", "sunset": "iso8601",
}
TEXTS = ("sunrise", "sunset")
TIME, DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2})?$", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def typed(x: str, pattern: str) -> str:
    return f"coalesce(schema_of_variant({x}) rlike '{pattern}', false)"


def fields_of(x: str) -> str:
    """SQL: the map of an object's fields; null for a variant that is no object."""
    return f"try_variant_get({x}, '$', 'map<string,variant>')"


NUMBER, VALUE = typed("{x}", "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), "try_variant_get({x}, '$', 'double')"
#: Tests of one value {x}, a variant that may be missing; each is true or false.
IS = {
    "text": typed("{x}", "^STRING") + r" and try_variant_get({x}, '$', 'string') rlike '\\S'",
    "number": NUMBER,
    "integer from 0": f"{NUMBER} and {VALUE} >= 0 and {VALUE} = floor({VALUE})",
}


def aligned(payloads: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(request, place from 0, ...) with `item`, the part of its request's payload (request, payload) that answers it, or null.

    An item's location_id says its place, if it is one; else its position does.  Of
    several items for one place the first counts.
    """
    sizes = asked.groupBy("request").agg(F.count("*").alias("_n"))
    one = "array(payload)"
    several = "try_variant_get(payload, '$', 'array<variant>')"
    items = payloads.join(sizes, "request").select("request", "_n", F.posexplode(F.expr(f"if(_n = 1, {one}, {several})")).alias("_at", "item"))
    own = "try_variant_get(item, '$.location_id', 'double')"
    number = IS["integer from 0"].format(x="try_variant_get(item, '$.location_id', 'variant')")
    placed = items.withColumn("place", F.expr(f"cast(if({number} and {own} < _n, {own}, _at) as int)")).where("place < _n")
    first = F.row_number().over(Window.partitionBy("request", "place").orderBy("_at"))
    found = placed.withColumn("_k", first).where("_k = 1").select("request", "place", "item")
    return asked.join(found, ["request", "place"], "left")


def axis(part: str, pattern: str) -> str:
    """SQL: the times of a part of `item` if all are of their form and rise, else null.  They are read once, not for each time again."""

    def checked(times: str) -> str:
        rising = f"forall(sequence(0, size({times}) - 1), i -> i = 0 or {times}[i] > {times}[i - 1])"
        return f"if(size({times}) > 0 and forall({times}, t -> coalesce(t rlike '{pattern}', false)) and {rising}, {times}, null)"

    return let(f"try_variant_get(item, '$.{part}.time', 'array<string>')", checked)


def column(part: str, variable: str, unit: str, times: str) -> str:
    """SQL: struct(unit, fits, odd, values) of a variable: is its unit as agreed, is its column as long as the times, does it hold something odd, its values."""
    unit_is = f"coalesce(lower(try_variant_get(item, '$.{part}_units.{variable}', 'string')) = '{unit}', false)"
    text = variable in TEXTS
    good = f"coalesce(try_variant_get(x, '$', 'string') rlike '{TIME}', false)" if text else IS["number"].format(x="x")
    kind = "string" if text else "double"
    value = f"if({good}, try_variant_get(x, '$', '{kind}'), null)"

    def told(raw: str, agreed: str, fits: str) -> str:
        odd = "false" if text else f"coalesce(exists({raw}, x -> not is_variant_null(x) and not ({good})), false)"
        return f"named_struct('unit', {agreed}, 'fits', {fits}, 'odd', {fits} and {odd}, 'v', if({fits}, transform({raw}, x -> {value}), cast(null as array<{kind}>)))"

    fitting = lambda raw, agreed: let(f"{agreed} and coalesce(size({raw}) = size({times}), false)", lambda fits: told(raw, agreed, fits))
    return let(f"try_variant_get(item, '$.{part}.{variable}', 'array<variant>')", lambda raw: let(unit_is, lambda agreed: fitting(raw, agreed)))


def read(payloads: DataFrame, asked: DataFrame) -> DataFrame:
    """Add to asked(request, place, timezone, ...): status (success or error), reason, hours, days and issues.

    hours and days: arrays of structs of time and values, null where a column is
    missing, has another length or another unit.  issues: array of (code, variable).
    """
    rows = aligned(payloads, asked).withColumn("_hours", F.expr(axis("hourly", TIME))).withColumn("_days", F.expr(axis("daily", DATE)))
    parts = [("hourly", "_hours", HOURLY_UNITS), ("daily", "_days", DAILY_UNITS)]
    rows = rows.select("*", *(F.expr(column(part, v, unit, times)).alias(f"_{part}_{v}") for part, times, units in parts for v, unit in units.items()))
    number = lambda name: IS["number"].format(x=f"try_variant_get(item, '$.{name}', 'variant')")
    reason = (
        F.when(F.expr(f"item is null or {fields_of('item')} is null"), "no-answer").when(F.expr("coalesce(try_variant_get(item, '$.error', 'boolean'), false)"), "provider-error")
        .when(F.expr(f"not ({number('latitude')}) or not ({number('longitude')}) or not ({IS['text'].format(x="try_variant_get(item, '$.timezone', 'variant')")})"), "incomplete").when(F.col("_hours").isNull(), "bad-hours")
    )
    told = [F.when(~F.expr("try_variant_get(item, '$.timezone', 'string') <=> timezone"), F.struct(F.lit("other-timezone").alias("code"), F.lit(None).cast("string").alias("variable")))]
    told.append(F.when(F.col("_days").isNull(), F.struct(F.lit("bad-days").alias("code"), F.lit(None).cast("string").alias("variable"))))
    for part, times, units in parts:
        for v in units:
            c = F.col(f"_{part}_{v}")
            for code, wrong in (("unit", ~c["unit"]), ("column", ~c["fits"]), ("value", c["odd"])):
                told.append(F.when(F.col(times).isNotNull() & wrong, F.struct(F.lit(code).alias("code"), F.lit(f"{part}.{v}").alias("variable"))))
    kind = lambda v: "string" if v in TEXTS else "double"

    def listed(part: str, times: str, units: dict) -> Column:
        """Values side by side, not looked up in a lambda: the optimizer would put a column's reading into it, once for each time."""
        values = [F.coalesce(F.col(f"_{part}_{v}")["v"], F.array().cast(f"array<{kind(v)}>")) for v in units]
        return F.arrays_zip(F.col(times), *values).cast(f"array<struct<time:string,{','.join(f'{v}:{kind(v)}' for v in units)}>>")

    made = rows.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "success").otherwise("error"))
    good = F.col("status") == "success"
    out = made.withColumn("hours", F.when(good, listed(*parts[0]))).withColumn("days", F.when(good, listed(*parts[1]))).withColumn("issues", F.when(good, F.array_compact(F.array(*told))))
    return out.select(*asked.columns, "status", "reason", "hours", "days", "issues")


def hours(read_: DataFrame, dates: str | None = None) -> DataFrame:
    """One row an hour of each place; dates: a column of days (texts) to which rows are kept.

    Outer, so that no filter on the hours is inferred and worked out below them again.
    """
    rows = read_.select("request", "place", *([F.col(dates).alias("_dates")] if dates else []), F.inline_outer("hours")).where("time is not null")
    kept = rows.where(F.expr("array_contains(_dates, left(time, 10))")).drop("_dates") if dates else rows
    return kept.withColumn("time", F.col("time").try_cast("timestamp_ntz"))


def days(read_: DataFrame) -> DataFrame:
    """One row a day of each place."""
    return read_.select("request", "place", F.inline_outer("days")).where("time is not null").withColumnRenamed("time", "date")


def statuses(read_: DataFrame) -> DataFrame:
    """request, status (success: all places, without an issue; error: no place; else partial), places, answered, issues and the dates covered."""
    covered = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("hours", lambda h: F.substring(h["time"], 1, 10))))))
    counted = read_.groupBy("request").agg(
        F.count("*").alias("places"), F.count_if(F.col("status") == "success").alias("answered"), F.coalesce(F.sum(F.when(F.col("status") == "success", F.size("issues"))), F.lit(0)).alias("issues"), covered.alias("dates"),
    )
    status = F.when(F.col("answered") == 0, "error").when((F.col("answered") == F.col("places")) & (F.col("issues") == 0), "success").otherwise("partial")
    return counted.withColumn("status", status)
