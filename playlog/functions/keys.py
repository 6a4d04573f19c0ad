"""Time keys of a play, and the range filters on them, for both shapes of a plays frame."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlog.functions.days import Day, Moment, as_day, as_minute
from playlog.schema import PARTITION_COLUMNS, TEXT_KEYS


def is_timestamped(plays: DataFrame) -> bool:
    return "ts" in plays.columns


def is_partitioned(plays: DataFrame) -> bool:
    return set(PARTITION_COLUMNS) <= set(plays.columns)


def text_key(plays: DataFrame, key: str) -> Column:
    """One of ``ym, ymd, ymdh, ymdhm``."""
    if is_timestamped(plays):
        return F.substring(F.col("ts").cast("string"), 1, TEXT_KEYS[key])
    return F.col(key)


def with_text_keys(plays: DataFrame) -> DataFrame:
    """All text keys as columns. Keys nobody selects are pruned from the plan."""
    if not is_timestamped(plays):
        return plays
    return plays.withColumns({key: text_key(plays, key) for key in TEXT_KEYS})


def play_day(plays: DataFrame) -> Column:
    """The day of a play as a date; null when a stored key is no date."""
    if is_partitioned(plays):
        return number_day(day_number(plays))
    if is_timestamped(plays):
        return F.to_date("ts")
    return F.col("ymd").try_cast("date")


def day_number(plays: DataFrame) -> Column:
    """The day of a play as the number yyyymmdd, from the partition columns where there are any: these decide the day.

    Null when a stored key is no date. A number is made of any partition values, so an impossible one cannot fail; it
    just never equals a real day's.
    """
    if is_partitioned(plays):
        year, month, day = (F.col(c).cast("int") for c in PARTITION_COLUMNS)
        return year * 10000 + month * 100 + day
    return date_number(play_day(plays))


def date_number(day: Column) -> Column:
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def number_day(number: Column) -> Column:
    """A day from its number; null when it is none."""
    return F.try_to_timestamp(F.lpad(number.cast("string"), 8, "0"), F.lit("yyyyMMdd")).cast("date")


def _in_partitions(plays: DataFrame, first: dt.date, last: dt.date) -> Column:
    """A filter on the partition columns. The plain comparison on year is one a metastore can answer."""
    year = F.col(PARTITION_COLUMNS[0]).cast("int")
    ends = (int(day.strftime("%Y%m%d")) for day in (first, last))
    return year.between(first.year, last.year) & day_number(plays).between(*ends)


def play_time(plays: DataFrame) -> Column:
    """The time of a play; null when a stored minute key is not ``yyyy-MM-dd HH:mm``.

    Where the separators stand decides, and that a digit ends it: other texts that the cast would take are no keys. A
    pattern match per row costs more than twice the cast itself.
    """
    if is_timestamped(plays):
        return F.col("ts")
    key = F.col("ymdhm")
    marks = {5: "-", 8: "-", 11: " ", 14: ":"}
    formed = F.length(key) == TEXT_KEYS["ymdhm"]
    for place, mark in marks.items():
        formed &= F.substring(key, place, 1) == mark
    formed &= F.substring(key, 1, 1).between("0", "9") & F.substring(key, 16, 1).between("0", "9")
    return F.when(formed, key.try_cast("timestamp_ntz"))


def within_days(plays: DataFrame, start: Day, end: Day) -> DataFrame:
    """Plays of the days start..end, both inclusive.

    The filter is put on what the source stores, so that it prunes: partition columns become partition filters, a
    timestamp or a stored day key is pushed into the scan. Rows without the key drop out.
    """
    first, last = as_day(start), as_day(end)
    if is_partitioned(plays):
        return plays.where(_in_partitions(plays, first, last))
    if is_timestamped(plays):
        return plays.where(F.to_date("ts").between(F.lit(first), F.lit(last)))
    return plays.where(F.col("ymd").between(first.isoformat(), last.isoformat()))


def within_minutes(plays: DataFrame, start: Moment, end: Moment) -> DataFrame:
    """Plays from start to end, both inclusive to the minute."""
    first, last = as_minute(start), as_minute(end)
    if is_partitioned(plays):
        plays = plays.where(_in_partitions(plays, first.date(), last.date()))
    if is_timestamped(plays):
        kind = plays.schema["ts"].dataType
        after = last + dt.timedelta(minutes=1)
        return plays.where(
            (F.col("ts") >= F.lit(str(first)).cast(kind)) & (F.col("ts") < F.lit(str(after)).cast(kind))
        )
    # Stored keys are zero padded, so padded text compares like time and the filter reaches the scan; the filter on
    # the day prunes the partitions of a dataset written by day.
    minute = F.col("ymdhm").between(first.isoformat(" ", "minutes"), last.isoformat(" ", "minutes"))
    day = F.col("ymd").between(first.date().isoformat(), last.date().isoformat())
    return plays.where(minute & (day | F.col("ymd").isNull()))
