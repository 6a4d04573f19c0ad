"""Minutes played per time bucket and genre.

Every function is one scan and one map-side combined aggregation over the plays; what is sorted or ranked afterwards
has one row per bucket and genre, or per genre.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlog.functions.days import Day, day_range
from playlog.functions.keys import is_timestamped, play_day, play_time, within_days
from playlog.functions.minutes import minute_sums, shown, sum_minutes

BUCKETS = ["Time", "Date", "Month"]


def bucket_of(table: DataFrame) -> str:
    """The bucket column of a table made here."""
    return next(name for name in BUCKETS if name in table.columns)


def largest_first(table: DataFrame) -> DataFrame:
    """Largest minutes first, ties by bucket and genre."""
    return shown(table).orderBy(F.desc_nulls_last("minsplayed"), bucket_of(table), "genre")


def minute_minutes(plays: DataFrame, start: Day, end: Day) -> DataFrame:
    """``ymdhm, genre, minsplayed`` in order of time; a group without any minutes stays null."""
    plays = within_days(plays, *day_range(start, end))
    if is_timestamped(plays):
        # Two integers are cheaper to group by than a text made for each play; the text is made once per group.
        minute = F.hour("ts") * 60 + F.minute("ts")
        sums = sum_minutes(plays, {"_day": F.to_date("ts"), "_minute": minute, "genre": F.col("genre")}, zero=False)
        clock = F.format_string("%02d:%02d", F.floor(F.col("_minute") / 60), F.col("_minute") % 60)
        sums = sums.select(F.concat_ws(" ", F.col("_day").cast("string"), clock).alias("ymdhm"), "genre", "minsplayed")
    else:
        sums = sum_minutes(plays, {"ymdhm": F.col("ymdhm"), "genre": F.col("genre")}, zero=False)
    return shown(sums).orderBy("ymdhm", "genre")


def _hours(plays: DataFrame) -> DataFrame:
    # Grouping by day and hour as two integers is cheaper than by a truncated timestamp, and knows no time zone. The
    # timestamp is put together once per group.
    plays = plays.withColumn("_time", play_time(plays))
    keys = {"_day": F.to_date("_time"), "_hour": F.hour("_time"), "genre": F.col("genre")}
    hour = F.col("_day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("_hour"))
    return sum_minutes(plays, keys, zero=True).select(hour.alias("Time"), "genre", "minsplayed")


def _days(plays: DataFrame, zero: bool) -> DataFrame:
    return sum_minutes(plays, {"Date": play_day(plays), "genre": F.col("genre")}, zero)


def _months(plays: DataFrame) -> DataFrame:
    return sum_minutes(plays, {"Month": F.trunc(play_day(plays), "month"), "genre": F.col("genre")}, zero=True)


def _month_days(plays: DataFrame) -> DataFrame:
    days = _days(plays, zero=False)
    return days.select(F.trunc("Date", "month").alias("Month"), "genre", "minsplayed")


def hourly_minutes(plays: DataFrame, start: Day, end: Day) -> DataFrame:
    """``Time, genre, minsplayed``, largest first."""
    return largest_first(_hours(within_days(plays, *day_range(start, end))))


def daily_minutes(plays: DataFrame, start: Day, end: Day) -> DataFrame:
    """``Date, genre, minsplayed``, largest first."""
    return largest_first(_days(within_days(plays, *day_range(start, end)), zero=True))


def month_day_rows(plays: DataFrame, start: Day, end: Day) -> DataFrame:
    """``Month, genre, minsplayed``: day sums labelled with their month, not summed further; largest first."""
    return largest_first(_month_days(within_days(plays, *day_range(start, end))))


def monthly_minutes(plays: DataFrame, start: Day, end: Day) -> DataFrame:
    """``Month, genre, minsplayed``, largest first."""
    return largest_first(_months(within_days(plays, *day_range(start, end))))


def grain(start: Day, end: Day) -> str:
    """One day is shown by hour, up to 31 days by day, more by month."""
    first, last = day_range(start, end)
    days = (last - first).days
    return "hour" if days == 0 else "day" if days <= 30 else "month"


def _buckets(plays: DataFrame, start: Day, end: Day) -> DataFrame:
    chosen = grain(start, end)
    plays = within_days(plays, start, end)
    if chosen == "hour":
        return _hours(plays)
    if chosen == "day":
        return _days(plays, zero=True)
    return _month_days(plays)


def play_minutes(plays: DataFrame, start: Day, end: Day) -> DataFrame:
    """The table of a range, at the grain its length asks for, largest first."""
    return largest_first(_buckets(plays, start, end))


def play_series(plays: DataFrame, start: Day, end: Day) -> DataFrame:
    """The chart data of a range: as the table, but months are summed."""
    if grain(start, end) == "month":
        return monthly_minutes(plays, start, end)
    return play_minutes(plays, start, end)


def _standing(table: DataFrame) -> Column:
    """Where a genre first shows in a table sorted largest first: its largest value, then the earliest bucket of it."""
    value = F.col("minsplayed")
    bucket = F.col(bucket_of(table))
    return F.min(F.struct(value.isNull().alias("none"), (-value).alias("value"), bucket.alias("bucket")))


def genre_order(table: DataFrame) -> DataFrame:
    """``genre, genre_rank``: genres in order of first appearance in the largest-first order of a table.

    The window is not partitioned: it sees the aggregated table's genres, one row each, never plays.
    """
    genres = table.groupBy("genre").agg(_standing(table).alias("_standing"))
    rank = F.row_number().over(Window.orderBy("_standing", "genre"))
    return genres.select("genre", rank.alias("genre_rank"))


def with_genre_rank(table: DataFrame) -> DataFrame:
    """A table with the rank of each row's genre as ``genre_rank``, largest minutes first."""
    ranks = genre_order(table).withColumnRenamed("genre", "_genre")
    ranked = table.join(ranks, F.col("genre").eqNullSafe(F.col("_genre")), "left").drop("_genre")
    return largest_first(ranked)


def genre_totals(plays: DataFrame, start: Day, end: Day) -> DataFrame:
    """``genre, minsplayed`` over a range, smallest first; equal totals in order of the genres' first appearance."""
    table = _buckets(plays, start, end)
    totals = table.groupBy("genre").agg(
        F.coalesce(F.sum("minsplayed"), F.lit(0)).alias("minsplayed"),
        _standing(table).alias("_standing"),
    )
    return shown(totals).orderBy("minsplayed", "_standing", "genre").select("genre", "minsplayed")


PARTS = ("table", "series", "totals")


def all_parts(plays: DataFrame, start: Day, end: Day) -> DataFrame:
    """``part, bucket, genre, minsplayed``: table, chart and totals of a range, summed in one scan and one shuffle.

    The parts are grouping sets: by bucket and genre, by month and genre where the chart has months, and by genre. ``bucket``
    is a time for hours and a date otherwise, kept as a timestamp; it is null for totals. ``part_of`` gives a part in the form of
    its own query. To use several parts, cache the frame: it has a row per bucket and genre.
    """
    chosen = grain(start, end)
    plays = within_days(plays, *day_range(start, end))
    day = play_day(plays)
    keys = {"_day": day, "_hour": F.lit(0), "_month": F.trunc(day, "month"), "genre": F.col("genre")}
    if chosen == "hour":
        plays = plays.withColumn("_time", play_time(plays))
        keys |= {"_day": F.to_date("_time"), "_hour": F.hour("_time")}
    named = plays.select(*[column.alias(name) for name, column in keys.items()], "minsplayed")
    sets = [["_day", "_hour", "genre"], *([["_month", "genre"]] if chosen == "month" else []), ["genre"]]
    summed, counts = minute_sums(plays.schema["minsplayed"].dataType)
    grouped = named.groupingSets([[F.col(name) for name in own] for own in sets], *keys).agg(*summed, F.grouping_id().alias("_set"))
    # The bits of the columns that a set leaves out, the last column's the lowest.
    table, series = (sum(1 << k for k, name in enumerate(reversed(list(keys))) if name not in own) for own in (sets[0], sets[-2]))
    part = F.when(F.col("_set") == table, "table").when(F.col("_set") == series, "series").otherwise("totals")
    # As in their own queries, only the day rows of a table of months may have no minutes at all.
    minutes = counts if chosen == "month" else F.coalesce(counts, F.lit(0))
    minutes = F.when(part == "table", minutes).otherwise(F.coalesce(counts, F.lit(0)))
    time = F.col("_day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("_hour"))
    bucket = F.when(part == "table", time).when(part == "series", F.col("_month").cast("timestamp_ntz"))
    return shown(grouped.select(part.alias("part"), bucket.alias("bucket"), "genre", minutes.alias("minsplayed")))


def part_of(parts: DataFrame, part: str, start: Day, end: Day) -> DataFrame:
    """A part of ``all_parts`` as ``play_minutes``, ``play_series`` or ``genre_totals`` gives it, in their order."""
    chosen = grain(start, end)
    if part == "totals":
        # Equal totals in order of the genres' first appearance in the table.
        ranks = genre_order(_bucketed(parts.where(F.col("part") == "table"), chosen)).withColumnRenamed("genre", "_genre")
        totals = parts.where(F.col("part") == "totals").select("genre", "minsplayed")
        totals = totals.join(ranks, F.col("genre").eqNullSafe(F.col("_genre")), "left")
        return totals.orderBy("minsplayed", "genre_rank").select("genre", "minsplayed")
    if part not in PARTS:
        raise ValueError(f"a part is one of {', '.join(PARTS)}, not {part}")
    # Only months have a chart of their own.
    rows = parts.where(F.col("part") == (part if chosen == "month" else "table"))
    return largest_first(_bucketed(rows, chosen))


def _bucketed(rows: DataFrame, chosen: str) -> DataFrame:
    bucket = {
        "hour": F.col("bucket").alias("Time"),
        "day": F.col("bucket").cast("date").alias("Date"),
        "month": F.trunc(F.col("bucket").cast("date"), "month").alias("Month"),
    }[chosen]
    return rows.select(bucket, "genre", "minsplayed")
