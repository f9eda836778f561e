"""Dates.  The reference day is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BACKFILL_DAYS = 365


def week_index(start: Column, today: Column, weeks: Column) -> Column:
    """Week of a programme, from 1 to its length."""
    return F.greatest(F.lit(1), F.least(weeks, (F.floor(F.datediff(today, start) / 7) + 1).cast("int")))


def open_week_index(start: Column, today: Column) -> Column:
    """As week_index, without the upper end."""
    return F.greatest(F.lit(1), (F.floor(F.datediff(today, start) / 7) + 1).cast("int"))


def weeks_out(event: Column, today: Column) -> Column:
    """Whole weeks until the event; null once it has passed."""
    days = F.datediff(event, today)
    return F.when(days >= 0, F.floor(days / 7).cast("int"))


def iso_date(text: Column) -> Column:
    """A yyyy-MM-dd date, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def clamped_log_date(text: Column, today: Column, back: int = MAX_BACKFILL_DAYS) -> Column:
    """The given day if it is within a year back from today, else today."""
    day = iso_date(text)
    return F.when((day <= today) & (day >= F.date_sub(today, back)), day).otherwise(today)


def today_in(ts: Column, zone: Column, zones: list[str]) -> Column:
    """The day at a UTC instant in a zone of the list; any other zone counts as UTC."""
    safe = F.when(zone.isin(zones), zone).otherwise("UTC")
    return F.to_date(F.from_utc_timestamp(ts, safe))


def within_days(day: Column, today: Column, days: int) -> Column:
    return day >= F.date_sub(today, days)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with their fraction between two timestamps without zone."""
    return F.timestamp_diff("MICROSECOND", start, end) / 1_000_000
