"""Validation of a relational trip model: every rule yields issue rows, and all are gathered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_issues(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Row rules: code -> condition that is broken.  One pass over the table for all of them."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules.items()]))
    return rows.select(F.col(key).cast("string").alias("id"), F.explode(found).alias("code"))


def duplicate_issues(rows: DataFrame, key: str, code: str = "duplicate-id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).cast("string").alias("id"), F.lit(code).alias("code"))


def reference_issues(rows: DataFrame, key: str, reference: str, known: DataFrame, known_key: str, code: str = "unknown-reference") -> DataFrame:
    """References to rows that don't exist; null references are no issue."""
    some = rows.where(F.col(reference).isNotNull())
    lost = some.join(known.select(F.col(known_key).alias(reference)).distinct(), reference, "left_anti")
    return lost.select(F.col(key).cast("string").alias("id"), F.lit(code).alias("code"))


def sequence_issues(rows: DataFrame, key: str, group: str, index: str, code: str = "index-gap") -> DataFrame:
    """An index must run from 0 without gaps in its group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(index, key)) - 1
    return rows.withColumn("_place", place).where(F.col("_place") != F.col(index)).select(F.col(key).cast("string").alias("id"), F.lit(code).alias("code"))


def increasing_issues(rows: DataFrame, key: str, group: str, index: str, value: str, code: str = "not-increasing") -> DataFrame:
    """A value must grow strictly along its group."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(index))
    return rows.withColumn("_before", before).where(F.col(value) <= F.col("_before")).select(F.col(key).cast("string").alias("id"), F.lit(code).alias("code"))


def date_issues(rows: DataFrame, key: str, date: str, start: str, index: str, code: str = "date-mismatch") -> DataFrame:
    """Days whose date isn't the trip's first date plus their index; without a first date, no day has one."""
    wrong = F.when(F.col(start).isNull(), F.col(date).isNotNull()).otherwise(~F.col(date).eqNullSafe(F.date_add(F.col(start), F.col(index).cast("int"))))
    return rows.where(wrong).select(F.col(key).cast("string").alias("id"), F.lit(code).alias("code"))


def mirror_issues(left: DataFrame, left_key: str, to: str, right: DataFrame, right_key: str, back: str, code: str = "relation-not-mutual") -> DataFrame:
    """Rows that point (by `to`) at a row of the other side that is missing or doesn't point back; null points at nothing."""
    pointing = left.where(F.col(to).isNotNull()).select(F.col(left_key).alias("_l"), F.col(to).alias("_r"))
    answers = right.where(F.col(back).isNotNull()).select(F.col(right_key).alias("_r"), F.col(back).alias("_l")).distinct()
    return pointing.join(answers, ["_l", "_r"], "left_anti").select(F.col("_l").cast("string").alias("id"), F.lit(code).alias("code"))


def sum_issues(rows: DataFrame, key: str, total: str, parts: tuple[str, ...], tolerance: float, code: str = "total-mismatch") -> DataFrame:
    """Totals farther from the sum of their parts than the tolerance; nothing is said where a value is null."""
    gap = F.abs(F.col(total) - sum((F.col(p) for p in parts[1:]), F.col(parts[0])))
    return rows.where(gap > tolerance).select(F.col(key).cast("string").alias("id"), F.lit(code).alias("code"))


def unique_issues(rows: DataFrame, key: str, group: str, value: str, code: str = "duplicate-order") -> DataFrame:
    """Rows whose value stands more than once in their group."""
    n = F.count("*").over(Window.partitionBy(group, value))
    return rows.where(F.col(value).isNotNull()).withColumn("_n", n).where("_n > 1").select(F.col(key).cast("string").alias("id"), F.lit(code).alias("code"))


def gathered(*issues: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def versions(bundles: DataFrame, current: int, migrations: tuple[int, ...]) -> DataFrame:
    """Which bundles load as they are, by a chain of migrations, or not at all (from the future, or without a way)."""
    v = F.col("schema_version")
    chain = F.forall(F.sequence(v, F.lit(current - 1)), lambda k: k.isin(*migrations)) if migrations else F.lit(False)
    status = F.when(v == current, "current").when(v > current, "future").when(v.isNull() | (v < 1), "invalid").when(chain, "migrate").otherwise("no-migration")
    return bundles.withColumn("status", status)
