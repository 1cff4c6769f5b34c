"""Dates, batch ids and dense calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.numbers import col_of, pad_left

ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"  # fixed value
BATCH_ID = r"^B-([0-9]{4})([0-9]{2})([0-9]{2})-"  # fixed value


def strict_date(text: Column | str) -> Column:
    """A real calendar day written exactly yyyy-MM-dd, else null.

    The cast alone would also take 2025-2-3 and timestamps.
    """
    text = col_of(text)
    return F.when(text.rlike(ISO_DATE), text.try_cast("date"))


def batch_date(batch_id: Column | str) -> Column:
    """Business date text inside a batch id, `unknown` for other ids."""
    batch_id = col_of(batch_id)
    day = F.concat_ws("-", *[F.regexp_extract(batch_id, BATCH_ID, g) for g in (1, 2, 3)])
    return F.when(batch_id.rlike(BATCH_ID), day).otherwise(F.lit("unknown"))


def make_batch_id(day: Column, number: Column | int) -> Column:
    number = F.lit(number) if isinstance(number, int) else number
    return F.concat(F.lit("B-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), pad_left(number, 2))


def add_hours(moment: Column, hours: Column) -> Column:
    """Hours as a number; fractions count."""
    return moment + F.make_dt_interval(mins=(hours * 60).cast("int"))


def minutes_between(late: Column, early: Column) -> Column:
    return seconds_between(late, early) / F.lit(60.0)


def seconds_between(late: Column, early: Column) -> Column:
    return (F.unix_micros(late) - F.unix_micros(early)) / F.lit(1_000_000.0)


def as_timestamp(value: Column | str) -> Column:
    """Accept `2026-01-31 10:00:00` text or a column."""
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value


def as_date(value: Column | str) -> Column:
    return F.lit(value).cast("date") if isinstance(value, str) else value


def trend_days(last_day: Column | str, days: int) -> Column:
    """Array of `days` dates ending at `last_day`."""
    last = as_date(last_day)
    return F.sequence(F.date_sub(last, days - 1), last)


def calendar(df: DataFrame, last_day: Column | str, days: int, name: str = "day") -> DataFrame:
    """One row per day of the trend window, independent of what `df` holds."""
    one = df.sparkSession.range(1)
    return one.select(F.explode(trend_days(last_day, days)).alias(name))


def batch_place(batch_id: Column) -> Column:
    """What orders batches: the text before the number, then the number itself, so 100 comes after 99."""
    number = F.regexp_extract(batch_id, r"([0-9]+)$", 1).try_cast("long")
    return F.struct(F.regexp_replace(batch_id, r"[0-9]+$", "").alias("before"), number.alias("number"))
