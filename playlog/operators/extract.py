"""Extraction: one customer and range, or a whole table of requests, in one plan.

A request has ``dataset, customerID, from, to``, the last two as dates or as text (``yyyyMMdd`` or ``yyyy-MM-dd``).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playlog.functions.days import Day, day_range, parse_day, report_day
from playlog.functions.keys import date_number, day_number, number_day, within_days
from playlog.functions.minutes import shown, sum_minutes
from playlog.messages import REPORT_EMPTY, REPORT_FOUND, REPORT_NONE, REPORT_READY

# What is broadcast has at most so many rows, and so many bytes of text and dates before Java's overhead.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def dataset_id(user: Column, requested_at: Column) -> Column:
    """User name and full request time, ``yyyyMMddHHmmss``."""
    digits = F.regexp_replace(requested_at.cast("string"), "[^0-9]", "")
    return F.concat(user, F.substring(digits, 1, 14))


def customer_extract(source: DataFrame, customer: str, start: Day, end: Day) -> DataFrame:
    """All columns of one customer's plays of the days start..end."""
    return within_days(source, *day_range(start, end)).where(F.col("customerID") == F.lit(str(customer)))


def merge_days(*days: DataFrame) -> DataFrame:
    """All rows of the given extracts."""
    return reduce(DataFrame.unionByName, days)


def daily_coverage(source: DataFrame, customer: str, start: Day, end: Day) -> DataFrame:
    """``day, n_rows, has_data`` for every day of the range, days without plays included."""
    first, last = day_range(start, end)
    plays = customer_extract(source, customer, first, last)
    counts = plays.groupBy(day_number(plays).alias("_number")).agg(F.count("*").alias("n_rows"))
    spine = source.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    # The counts have at most one row per day of the range, so their size is set by the parameters.
    n_rows = F.coalesce("n_rows", F.lit(0).cast("bigint"))
    return spine.withColumn("_number", date_number(F.col("day"))).join(F.broadcast(counts), "_number", "left").select(
        "day", n_rows.alias("n_rows"), (n_rows > 0).alias("has_data")
    )


# Requests spread over more days than this are spread over blocks of days instead, where these are far fewer.
SPREAD_DAYS = BROADCAST_ROWS
_DAY_ZERO = 719_162  # days from 0001-01-01 to 1970-01-01, so that the numbers of all days are positive
_LEVELS = 22  # blocks of up to so many doublings hold all days there are


def day_index(day: Column) -> Column:
    """Days since 0001-01-01."""
    return F.unix_date(day) + _DAY_ZERO


def day_blocks(first: Column, last: Column) -> Column:
    """The blocks of days that make up a range, as an array of ``level, block``.

    A block of a level holds the ``2 ** level`` days whose index, without its last ``level`` bits, is its number. A range has
    at most two blocks of each level, one at either end, so ten years are 22 blocks at most instead of 3,650 days.
    """
    start, end = day_index(first), day_index(last) + 1

    def of_level(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1), level)
        # What is left of the range when all smaller blocks are taken off, counted in blocks of this level.
        low = F.floor((start + size - 1) / size).cast("int")
        high = F.floor(end / size).cast("int")
        odd_low, odd_high = low % 2 == 1, high % 2 == 1
        block = [F.struct(level.alias("level"), number.alias("block")) for number in (low, high - 1)]
        at_low = F.when(odd_low & (low < high), F.array(block[0])).otherwise(F.array())
        at_high = F.when(odd_high & (low + odd_low.cast("int") < high), F.array(block[1])).otherwise(F.array())
        return F.concat(at_low, at_high)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS)), of_level))


@dataclass(frozen=True)
class RequestDays:
    """Requests spread over their days, one row per request and day, and what is known of them as a whole."""

    days: DataFrame
    first: dt.date | None
    last: dt.date | None
    small: bool
    customers: DataFrame | None
    """The requested customers, where the requests are not small but these are."""
    blocks: DataFrame | None = None
    """One row per request and block of days, where days are many: joins go by these."""
    levels: tuple[int, ...] = ()
    small_blocks: bool = False

    def _in_blocks(self, plays: DataFrame) -> DataFrame:
        """Plays once for each level that a request has a block of."""
        index = day_index(number_day(F.col("day_number")))
        blocks = [F.struct(F.lit(level).alias("level"), F.shiftright(index, level).alias("block")) for level in self.levels]
        named = [F.col(f"`{name}`") for name in plays.columns]
        return plays.select(*named, F.explode(F.array(*blocks)).alias("_in")).select(*named, "_in.level", "_in.block")

    def join(self, plays: DataFrame) -> DataFrame:
        """Plays, or sums of plays, with the requests they belong to.

        Customer and day together are the join key: a play meets only requests that hold it, never all requests of
        its customer, and a customer with a large part of the plays is spread over its days. Small requests are
        broadcast, so that plays are not shuffled; others go through a shuffle join, where adaptive execution splits
        the partitions that are still too large. Where requests are long, blocks of days take the place of days: a play is
        looked up once for each size of block, and belongs to a request by exactly one of them.
        """
        if self.blocks is not None:
            blocks = F.broadcast(self.blocks) if self.small_blocks else self.blocks
            keys = ["customerID", "level", "block"]
            return self._in_blocks(plays).join(blocks, keys, "inner").drop("level", "block")
        days = F.broadcast(self.days) if self.small else self.days
        return plays.join(days, ["customerID", "day_number"], "inner")

    def asked(self, plays: DataFrame) -> DataFrame:
        """Plays without those that surely nobody asks for: they are dropped where they are read, before a shuffle."""
        if self.small:
            keys = ["customerID", "day_number"]
            return plays.join(F.broadcast(self.days.select(*keys)), keys, "left_semi")
        if self.customers is not None:
            return plays.join(F.broadcast(self.customers), "customerID", "left_semi")
        return plays


def typed_requests(requests: DataFrame) -> DataFrame:
    """Requests with their dates as dates; null where a text is none."""
    texts = [name for name in ("from", "to") if isinstance(requests.schema[name].dataType, T.StringType)]
    return requests.withColumns({name: parse_day(F.col(name)) for name in texts}) if texts else requests


def _measure(frame: DataFrame, *more: Column) -> Row:
    """Rows and bytes of a frame, and more aggregates, as one row."""
    width = F.lit(16).cast("bigint")
    for name in ("dataset", "customerID"):
        if name in frame.columns:
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
    return frame.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("size"), *more).first()


def _fits(measured: Row) -> bool:
    return measured["n"] <= BROADCAST_ROWS and measured["size"] <= BROADCAST_BYTES


def request_days(requests: DataFrame, spread: str = "auto") -> RequestDays:
    """Spread requests over their days and measure them: single aggregated rows come to the driver.

    A request without dates, or with its dates reversed, has no days. Where requests have many days, on average far more
    than they have blocks of days, they are joined by blocks; ``spread`` asks for ``days`` or ``blocks`` instead.
    """
    if spread not in ("auto", "days", "blocks"):
        raise ValueError(f"spread is auto, days or blocks, not {spread}")
    requests = typed_requests(requests).where(F.col("from") <= F.col("to"))
    days = requests.select("dataset", "customerID", F.explode(F.sequence("from", "to")).alias("request_day"))
    days = days.withColumn("day_number", date_number(F.col("request_day")))
    length = F.datediff("to", "from") + 1
    whole = _measure(
        requests,
        F.min("from").alias("first"),
        F.max("to").alias("last"),
        F.coalesce(F.sum(length), F.lit(0)).alias("days"),
        F.coalesce(F.max(length), F.lit(0)).alias("longest"),
    )
    by_blocks = spread == "blocks" or (
        spread == "auto" and whole["days"] > SPREAD_DAYS and whole["days"] > whole["n"] * 4 * whole["longest"].bit_length()
    )
    if by_blocks and whole["n"]:
        blocks = requests.select("dataset", "customerID", F.explode(day_blocks(F.col("from"), F.col("to"))).alias("_in"))
        blocks = blocks.select("dataset", "customerID", "_in.level", "_in.block")
        measured = _measure(blocks, F.collect_set("level").alias("levels"))
        levels = tuple(sorted(measured["levels"]))
        return RequestDays(days, whole["first"], whole["last"], False, _small_customers(requests), blocks, levels, _fits(measured))
    # The day's number and date, and the width of the texts, which each day repeats.
    small = whole["days"] <= BROADCAST_ROWS and _fits(_measure(days))
    return RequestDays(days, whole["first"], whole["last"], small, None if small else _small_customers(requests))


def _small_customers(requests: DataFrame) -> DataFrame | None:
    distinct = requests.select("customerID").distinct()
    return distinct if _fits(_measure(distinct)) else None


def _plays_of(source: DataFrame, wanted: RequestDays) -> DataFrame:
    """The plays inside the outer range of all requests, with their day."""
    plays = within_days(source, wanted.first, wanted.last) if wanted.first else source.where(F.lit(False))
    return plays.withColumn("day_number", day_number(source))


def batch_extract(source: DataFrame, requests: DataFrame, spread: str = "auto") -> DataFrame:
    """The plays of every request, led by ``dataset``. A play held by several requests is there once for each."""
    wanted = request_days(requests, spread)
    plays = _plays_of(source, wanted)
    if not wanted.small:
        plays = wanted.asked(plays)
    return wanted.join(plays).select("dataset", *source.columns)


def _daily_sums(source: DataFrame, wanted: RequestDays) -> DataFrame:
    """Rows and minutes per customer and day."""
    keys = {name: F.col(name) for name in ("customerID", "day_number")}
    return sum_minutes(wanted.asked(_plays_of(source, wanted)), keys, zero=False, count="n")


def request_counts(source: DataFrame, requests: DataFrame, spread: str = "auto") -> DataFrame:
    """``dataset, n_rows, minsplayed`` of the requests that have plays.

    Plays are first combined per customer and day; only those sums meet the requests.
    """
    wanted = request_days(requests, spread)
    sums = wanted.join(_daily_sums(source, wanted)).groupBy("dataset")
    return shown(sums.agg(F.sum("n").alias("n_rows"), F.sum("minsplayed").alias("minsplayed")))


def batch_coverage(source: DataFrame, requests: DataFrame) -> DataFrame:
    """``dataset, customerID, day, n_rows, has_data`` for every day of every request."""
    wanted = request_days(requests, "days")
    n_rows = F.coalesce("n", F.lit(0).cast("bigint"))
    return wanted.days.join(_daily_sums(source, wanted), ["customerID", "day_number"], "left").select(
        "dataset",
        "customerID",
        F.col("request_day").alias("day"),
        n_rows.alias("n_rows"),
        (n_rows > 0).alias("has_data"),
    )


def extract_report(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """``dataset, customerID, n_rows, subject, message``: what the requester is told.

    ``counts`` has ``dataset, n_rows``, from the written datasets (``dataset_catalog``) or from ``request_counts``.
    """
    requests = typed_requests(requests)
    n_rows = F.coalesce("n_rows", F.lit(0).cast("bigint"))
    found = n_rows > 0
    asked = F.format_string(
        "Customer %s, %s - %s: ", F.col("customerID"), report_day(F.col("from")), report_day(F.col("to"))
    )
    return requests.join(counts.select("dataset", "n_rows"), "dataset", "left").select(
        "dataset",
        "customerID",
        n_rows.alias("n_rows"),
        F.when(found, REPORT_READY).otherwise(REPORT_EMPTY).alias("subject"),
        F.concat(
            asked,
            F.when(found, F.format_string(REPORT_FOUND, F.col("dataset"))).otherwise(REPORT_NONE),
        ).alias("message"),
    )
