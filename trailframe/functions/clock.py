"""Times of day, local timestamps and calendar dates, free of time zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailframe.functions.geo import js_round

DAY = 1440


def clock(departure_minutes: Column, elapsed_minutes: Column) -> Column:
    """struct(clock_minutes, day_offset) of a departure plus elapsed minutes, rounded to the minute."""
    total = js_round(departure_minutes + elapsed_minutes)
    return F.struct(F.pmod(total, F.lit(DAY)).cast("int").alias("clock_minutes"), F.floor(total / DAY).cast("int").alias("day_offset"))


def clock_text(clock_minutes: Column, day_offset: Column) -> Column:
    """HH:MM, with the days gone by where there are any."""
    text = F.concat_ws(":", F.lpad(F.floor(clock_minutes / 60).cast("string"), 2, "0"), F.lpad((clock_minutes % 60).cast("string"), 2, "0"))
    return F.when(day_offset == 0, text).otherwise(F.concat(text, F.lit(" (+"), day_offset.cast("string"), F.lit(" j)")))


def clock_phrase(clock_minutes: Column, day_offset: Column) -> Column:
    text = clock_text(clock_minutes, F.lit(0))
    later = F.concat(text, F.lit(", "), day_offset.cast("string"), F.lit(" jours plus tard"))
    return F.when(day_offset == 0, text).when(day_offset == 1, F.concat(text, F.lit(", le lendemain"))).otherwise(later)


def parse_clock(text: Column) -> Column:
    """Minutes from 0 to 1439 of HH:MM; null for anything else."""
    return F.when(
        text.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$"),
        F.substring(text, 1, 2).try_cast("int") * 60 + F.substring(text, 4, 2).try_cast("int"),
    )


def shifted_clock(clock_minutes: Column, day_offset: Column, by_minutes: Column) -> Column:
    """struct(clock_minutes, day_offset, coherent): a shift to before the first day isn't coherent."""
    total = day_offset * DAY + clock_minutes + by_minutes
    return F.struct(
        F.pmod(total, F.lit(DAY)).cast("int").alias("clock_minutes"), F.floor(total / DAY).cast("int").alias("day_offset"), (total >= 0).alias("coherent")
    )


def local_timestamp(date: Column, clock_minutes: Column, day_offset: Column) -> Column:
    """The local timestamp (without zone) of a clock on a trip's date."""
    return F.timestamp_add("MINUTE", (day_offset * DAY + clock_minutes).cast("int"), date.cast("timestamp_ntz"))


def ntz_seconds(at: Column) -> Column:
    """Seconds of a timestamp without zone since 1970, whatever the session's zone and its summer time."""
    since = at - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), since)
    return part("DAY") * 86_400 + part("HOUR") * 3_600 + part("MINUTE") * 60 + part("SECOND").cast("double")


def date_in_zone(instant: Column, zone: str) -> Column:
    """The civil date of an instant (timestamp with zone) in a time zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz")).cast("date")


def local_now(instant: Column, zone: str) -> Column:
    """yyyy-MM-ddTHH:mm of an instant in a time zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz"))
    return F.date_format(local, "yyyy-MM-dd'T'HH:mm")


def trip_period(date: Column, first: Column, last: Column) -> Column:
    """struct(kind, day, days_until): before the first day (day 1), during (its number), after the last (the last day's number)."""
    n = F.datediff(last, first) + 1
    kind = F.when(date < first, "before").when(date > last, "after").otherwise("during")
    day = F.when(date < first, F.lit(1)).when(date > last, n).otherwise(F.datediff(date, first) + 1)
    return F.struct(kind.alias("kind"), day.alias("day"), F.when(date < first, F.datediff(first, date)).alias("days_until"))
