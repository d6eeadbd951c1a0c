"""Dates, times of day (INT seconds) and calendar arithmetic as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardflow.functions.text import ColumnLike, col

DAY_SECONDS = 86_400


def moment(value: dt.datetime | str) -> Column:
    """A wall-clock literal for ``as_of`` arguments."""
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def seconds_of_day(ts: ColumnLike) -> Column:
    ts = col(ts)
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def clock_seconds(text: ColumnLike) -> Column:
    """``H:mm`` or ``HH:mm:ss`` text as seconds of the day."""
    parts = F.split(F.trim(col(text)), ":")
    seconds = F.coalesce(F.try_element_at(parts, F.lit(3)).cast("int"), F.lit(0))
    return F.element_at(parts, 1).cast("int") * 3600 + F.element_at(parts, 2).cast("int") * 60 + seconds


def clock_text(seconds: ColumnLike) -> Column:
    """Seconds of the day as ``HH:mm``."""
    s = col(seconds)
    return F.format_string("%02d:%02d", F.floor(s / 3600).cast("int"), (F.floor(s / 60) % 60).cast("int"))


def at_time(day: ColumnLike, seconds: ColumnLike) -> Column:
    """Wall-clock timestamp of a date plus seconds of the day."""
    zero = F.lit(0)
    return col(day).cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, col(seconds).cast("decimal(18,6)"))


def minutes_between_clocks(start: ColumnLike, end: ColumnLike) -> Column:
    """Minute boundaries crossed between two times of day (may be negative)."""
    return (F.floor(col(end) / 60) - F.floor(col(start) / 60)).cast("int")


def minutes_between(start: ColumnLike, end: ColumnLike) -> Column:
    """Minute boundaries crossed between two timestamps."""
    return F.timestamp_diff("MINUTE", F.date_trunc("MINUTE", col(start)), F.date_trunc("MINUTE", col(end)))


def weekday(ts: ColumnLike) -> Column:
    """English weekday name."""
    return F.date_format(col(ts), "EEEE")


def month_key(ts: ColumnLike) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def date_text(ts: ColumnLike) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd")


def day_first_text(ts: ColumnLike) -> Column:
    return F.date_format(col(ts), "dd/MM/yyyy")


def within_month(day: ColumnLike, month_date: ColumnLike) -> Column:
    """Same calendar month, written as a range so that it reaches the file scan."""
    first = F.trunc(col(month_date).cast("date"), "MM")
    return (col(day) >= first) & (col(day) < F.add_months(first, 1))


def at_least(value: ColumnLike, floor: int) -> Column:
    return F.greatest(col(value), F.lit(floor))
