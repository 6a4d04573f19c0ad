"""Raw rows, table pages and display labels."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from playlog.functions.days import Moment, as_minute
from playlog.functions.keys import with_text_keys, within_minutes
from playlog.messages import RANGE_TOO_LONG
from playlog.operators.aggregate import bucket_of
from playlog.schema import DEFAULT_EXPORT, EXPORT_COLUMNS

LONGEST_WINDOW = dt.timedelta(hours=6)


def raw_window(
    plays: DataFrame, start: Moment, end: Moment, columns: Sequence[str] = tuple(DEFAULT_EXPORT)
) -> DataFrame:
    """The picked columns of all plays from start to end, inclusive to the minute; at most 6 hours.

    A window that ends before it starts is empty.
    """
    if as_minute(end) - as_minute(start) > LONGEST_WINDOW:
        raise ValueError(RANGE_TOO_LONG)
    unknown = [name for name in columns if name not in EXPORT_COLUMNS]
    if unknown or not columns:
        raise ValueError(f"pick columns out of {', '.join(EXPORT_COLUMNS)}; not {', '.join(unknown) or 'none'}")
    return with_text_keys(within_minutes(plays, start, end)).select(*columns)


def page(table: DataFrame, number: int, order: Sequence[str | Column], size: int = 10) -> DataFrame:
    """Page ``number`` (from 0) of a table: a top-k, which never sorts the whole table."""
    return table.orderBy(*order).offset(number * size).limit(size)


@dataclass(frozen=True)
class SortKey:
    """A column of an order; nulls come last either way."""

    name: str
    descending: bool = False

    def order(self) -> Column:
        return F.desc_nulls_last(self.name) if self.descending else F.asc_nulls_last(self.name)

    def same(self, value: object) -> Column:
        return F.col(self.name).eqNullSafe(F.lit(value))

    def after(self, value: object) -> Column:
        """Whether a row comes later by this column than a value."""
        if value is None:
            return F.lit(False)
        column = F.col(self.name)
        later = column < F.lit(value) if self.descending else column > F.lit(value)
        return F.coalesce(later, F.lit(False)) | column.isNull()


def next_page(table: DataFrame, keys: Sequence[SortKey], last: Row | None = None, size: int = 10) -> DataFrame:
    """The page after the row ``last``, or the first one: a top-k of ``size`` rows, however far the page is.

    The keys must tell all rows apart. Unlike an offset, no earlier page is read again, and rows added or removed before it
    meanwhile shift nothing.
    """
    if last is not None:
        later = F.lit(False)
        for key in reversed(keys):
            later = key.after(last[key.name]) | (key.same(last[key.name]) & later)
        table = table.where(later)
    return table.orderBy(*[key.order() for key in keys]).limit(size)


def display_table(table: DataFrame) -> DataFrame:
    """A bucket table with its bucket as shown to people, and the label of its chart axis.

    Hours show as ``8:00``, days as ``09/4/2019``, months as ``4/2019``; on the axis as ``08:00``, ``09 Apr``, ``Apr``.
    """
    name = bucket_of(table)
    bucket = F.col(name)
    if name == "Time":
        shown = F.concat(F.hour(bucket).cast("string"), F.lit(":00"))
        axis = F.substring(bucket.cast("string"), 12, 5)
    elif name == "Date":
        shown = F.concat_ws(
            "/", F.lpad(F.dayofmonth(bucket).cast("string"), 2, "0"), F.month(bucket), F.year(bucket)
        )
        axis = F.date_format(bucket, "dd MMM")
    else:
        shown = F.concat_ws("/", F.month(bucket), F.year(bucket))
        axis = F.date_format(bucket, "MMM")
    return table.select(shown.alias(name), axis.alias("axis_label"), "genre", "minsplayed")
