"""Times of day as seconds from midnight (which may exceed a day), and dates of service."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def to_seconds(text: Column) -> Column:
    """'H:M:S' or 'n day(s), H:M:S' as seconds; empty parts are 0, null and blank are null."""
    days = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, r"(\d+)\s+days?", 1), F.lit("")), F.lit("999999")).cast("long"), F.lit(0))
    clock = F.split(F.regexp_replace(text, r"^\s*\d+\s+days?,\s*", ""), ":")
    part = lambda i: F.coalesce(F.nullif(F.trim(F.get(clock, F.lit(i))), F.lit("")), F.lit("0")).cast("double").cast("long")
    return F.when(F.trim(text) != "", days * DAY + part(0) * 3600 + part(1) * 60 + part(2))


def to_time_string(seconds: Column) -> Column:
    """Seconds as 'H:MM:SS', with 'n day(s), ' before it beyond a day."""
    days, rest = F.floor(seconds / DAY), F.pmod(seconds, F.lit(DAY))
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(F.pmod(rest, F.lit(3600)) / 60), F.pmod(rest, F.lit(60)))
    prefix = F.when(days == 1, F.lit("1 day, ")).when(days > 1, F.concat(days.cast("string"), F.lit(" days, "))).otherwise(F.lit(""))
    return F.concat(prefix, clock)


def gtfs_time(seconds: Column) -> Column:
    """Seconds as 'HH:MM:SS', hours beyond 24 kept, as stop times are written."""
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60)))


def one_day_before(date: Column) -> Column:
    return F.date_format(F.date_sub(F.to_date(date), 1), "yyyy-MM-dd")


def days_between(first: Column, last: Column) -> Column:
    """All dates from first to last, as an array."""
    return F.sequence(F.to_date(first), F.to_date(last), F.expr("interval 1 day"))


def day_of_week(date: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(F.to_date(date))


def format_date(compact: Column) -> Column:
    """'yyyymmdd' as 'yyyy-mm-dd'."""
    return F.date_format(F.to_date(compact, "yyyyMMdd"), "yyyy-MM-dd")
