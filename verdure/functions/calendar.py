"""Seasons, periods and day numbers, as column expressions."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Planting months typical of each season, and the month from which a dry season counts to the next year (fixed values).
TYPICAL = {"wet": (4, 5, 6, 7, 8), "dry": (9, 10, 11, 12, 1, 2, 3)}
ROLLOVER = 7


def parse_month(raw: Column) -> Column:
    """Month 1-12 of a number, a name or the first part of a range; otherwise null."""
    text = F.lower(F.trim(raw.cast("string")))
    first = F.trim(F.regexp_extract(text, "^([^-/–]*)", 1))
    number = F.bround(first.try_cast("double")).cast("int")
    names = F.create_map(*(x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(i))))
    named = F.when(F.length(first) >= 3, F.try_element_at(names, F.substring(first, 1, 3)))
    number = F.when(~F.isnan(first.try_cast("double")), number)
    return F.coalesce(F.when(number.between(1, 12), number), F.when(number.isNull(), named))


def planting_year(season_year: Column, month: Column, season: str) -> Column:
    """A dry season planted from July on began the year before."""
    return F.when((F.lit(season) == "dry") & (month >= ROLLOVER), season_year - 1).otherwise(season_year)


def default_season_year(day: Column, season: str) -> Column:
    return F.year(day) + F.when((F.lit(season) == "dry") & (F.month(day) >= ROLLOVER), 1).otherwise(0)


def season_start(month: Column, year: Column) -> Column:
    """First day of the month before planting."""
    return F.add_months(F.make_date(year, month, F.lit(1)), -1)


def season_end(month: Column, year: Column) -> Column:
    """Last day of the sixth month after planting."""
    return F.last_day(F.add_months(F.make_date(year, month, F.lit(1)), 6))


def window(month: int, year: int) -> tuple[dt.date, dt.date]:
    """``season_start`` and ``season_end`` of one planting month, for the driver."""
    first = dt.date(year + (month - 2) // 12, (month - 2) % 12 + 1, 1)
    y, m = year + (month + 5) // 12, (month + 5) % 12 + 1
    return first, dt.date(y, m, calendar.monthrange(y, m)[1])


def period_start(day: Column, period: str = "monthly") -> Column:
    first = F.trunc(day, "month")
    return first if period == "monthly" else F.when(F.dayofmonth(day) > 15, F.date_add(first, 15)).otherwise(first)


def period_end(start: Column, period: str = "monthly") -> Column:
    """Exclusive end."""
    nxt = F.add_months(F.trunc(start, "month"), 1)
    return nxt if period == "monthly" else F.when(F.dayofmonth(start) == 1, F.date_add(start, 15)).otherwise(nxt)


def period_label(start: Column, period: str = "monthly") -> Column:
    month = F.date_format(start, "yyyyMM")
    return month if period == "monthly" else F.concat(month, F.when(F.dayofmonth(start) == 1, F.lit("H1")).otherwise(F.lit("H2")))


def last_complete(day: Column, period: str = "monthly") -> Column:
    """Start of the newest period of which the day, or one before it, is the last."""
    own = period_start(day, period)
    return F.when(F.date_add(day, 1) >= period_end(own, period), own).otherwise(period_start(F.date_sub(own, 1), period))


def periods_between(start: Column, end: Column, period: str = "monthly") -> Column:
    """Starts of the periods that touch [start, end], as an array."""
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    if period == "monthly":
        return months
    halves = F.flatten(F.transform(months, lambda m: F.array(m, F.date_add(m, 15))))
    return F.filter(halves, lambda h: (period_end(h, period) > start) & (h <= end))


def day_of_year(day_number: Column, year: int) -> Column:
    """Day number relative to 1 January of the year, from 1; fractions stay."""
    return day_number - F.unix_date(F.lit(f"{year}-01-01").cast("date")) + 1


def season_label(season: str, year: Column) -> Column:
    return F.concat(F.lit(season), year.cast("string"))
