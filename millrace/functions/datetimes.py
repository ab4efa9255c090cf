"""Date and time functions (Column to Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from the start of Julian days to 1970-01-01 (fixed value).
JULIAN_EPOCH = 2440588


def _quarter_text(q: Column, kind: str, year: Column) -> Column:
    return F.concat(F.lit("Q"), q.cast("int").cast("string"), F.lit(kind), F.lpad((year % 100).cast("string"), 2, "0"))


def calendar_quarter(d: Column) -> Column:
    """Q1CY96."""
    return _quarter_text(F.quarter(d), "CY", F.year(d))


def fiscal_month(d: Column, first: int) -> Column:
    return (F.month(d) - first + 12) % 12 + 1


def fiscal_year(d: Column, first: int) -> Column:
    return F.year(d) + F.when((F.month(d) >= first) & F.lit(first != 1), 1).otherwise(0)


def fiscal_quarter(d: Column, first: int) -> Column:
    """Q2FY97."""
    return _quarter_text(F.floor((fiscal_month(d, first) - 1) / 3) + 1, "FY", fiscal_year(d, first))


def day_in_year(d: Column) -> Column:
    return F.dayofyear(d)


def day_number_overall(d: Column) -> Column:
    return F.unix_date(F.to_date(d))


def julian_day(d: Column) -> Column:
    return F.unix_date(F.to_date(d)) + JULIAN_EPOCH


def julian_to_date(n: Column) -> Column:
    return F.date_from_unix_date((n - JULIAN_EPOCH).cast("int"))


def pad_week_number(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def add_days(d: Column, n: Column) -> Column:
    return F.date_add(d, n)


def add_hours(ts: Column, n: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), n)


def days_diff(a: Column, b: Column) -> Column:
    return F.date_diff(a, b)


def hours_diff(a: Column, b: Column) -> Column:
    return F.timestamp_diff("HOUR", b, a)


#: Names of periods and the units they truncate to (fixed values).
PERIODS = {"HOURLY": "hour", "DAILY": "day", "WEEKLY": "week", "MONTHLY": "month", "YEARLY": "year"}


def truncate_timestamp(ts: Column, period: str) -> Column:
    """Floor to the period; weeks begin on Monday; any other text leaves the value."""
    return F.date_trunc(PERIODS[period], ts) if period in PERIODS else ts


def extract_timestamp(ts: Column, field: str) -> Column:
    """Field number; months count from 0, Sunday is day 1 of the week, HOW is the hour of the week."""
    fields = {"SECOND": F.second(ts), "MINUTE": F.minute(ts), "HOUR": F.hour(ts), "DAY": F.dayofmonth(ts), "DOW": F.dayofweek(ts), "DOY": F.dayofyear(ts), "WEEK": F.weekofyear(ts), "MONTH": F.month(ts) - 1, "YEAR": F.year(ts), "HOW": (F.dayofweek(ts) - 1) * 24 + F.hour(ts)}
    return fields[field]


def floor_to(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts)


def ceil_to(ts: Column, unit: str) -> Column:
    low = F.date_trunc(unit, ts)
    return F.when(low == ts, ts).otherwise(F.timestamp_add(unit.upper(), F.lit(1), low))


#: Letters of date masks and Spark's pattern letters (fixed values).
MASK = {"YYYY": "yyyy", "YY": "yy", "MON": "MMM", "MM": "MM", "DD": "dd", "HH24": "HH", "HH": "hh", "MI": "mm", "SS": "ss", "AM": "a"}


def mask_pattern(mask: str) -> str:
    out, i = "", 0
    while i < len(mask):
        for k in sorted(MASK, key=len, reverse=True):
            if mask[i:].upper().startswith(k):
                out, i = out + MASK[k], i + len(k)
                break
        else:
            out, i = out + (f"'{mask[i]}'" if mask[i].isalpha() else mask[i]), i + 1
    return out


def convert_date(s: Column, mask: str, reject: bool = False) -> Column:
    """Date of a string by a mask; what does not match is null, or raises with `reject`."""
    pattern = F.lit(mask_pattern(mask))
    return F.to_timestamp(s, mask_pattern(mask)).cast("date") if reject else F.try_to_timestamp(s, pattern).cast("date")


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """SQL OVERLAPS of two periods, each given by two ends in any order."""
    a, b, c, d = F.least(s1, e1), F.greatest(s1, e1), F.least(s2, e2), F.greatest(s2, e2)
    return ((a < d) & (c < b)) | (a == c)
