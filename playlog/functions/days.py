"""Calendar days given as parameters or typed as text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from playlog.messages import DATES_REVERSED

Day = dt.date | str
Moment = dt.datetime | str


def as_day(value: Day) -> dt.date:
    """A day from a date, ``yyyy-MM-dd`` or ``yyyyMMdd``."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    text = str(value).strip()
    return dt.datetime.strptime(text, "%Y%m%d" if text.isdigit() else "%Y-%m-%d").date()


def as_minute(value: Moment) -> dt.datetime:
    """A moment, cut to its minute, from a datetime or ``yyyy-MM-dd H:mm``."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime.strptime(str(value).strip(), "%Y-%m-%d %H:%M")
    return value.replace(second=0, microsecond=0)


def day_range(start: Day, end: Day) -> tuple[dt.date, dt.date]:
    """Both ends of a range, in order."""
    first, last = as_day(start), as_day(end)
    if last < first:
        raise ValueError(DATES_REVERSED)
    return first, last


def parse_day(text: Column) -> Column:
    """``yyyy-MM-dd`` or ``yyyyMMdd`` text to a date, null when it is neither."""
    dashed = F.regexp_replace(F.trim(text), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.when(dashed.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), dashed.try_cast("date"))


def parse_minute(day: Column, time: Column) -> Column:
    """A date and a typed ``H:mm`` to a timestamp without time zone, null when the time does not parse."""
    text = F.concat_ws(" ", day.cast("string"), F.trim(time))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}$"), text.try_cast("timestamp_ntz"))


def report_day(day: Column) -> Column:
    """``dd/MM/yyyy``."""
    return F.date_format(day, "dd/MM/yyyy")
