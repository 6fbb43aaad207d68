"""Column functions on dates and months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days in a month, for the remainder of an age.
MONTH_DAYS = 30.44


def months_between(earlier: Column, later: Column) -> Column:
    """Months by calendar, the rest of days by a month of 30.44."""
    months = (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    return months + (F.dayofmonth(later) - F.dayofmonth(earlier)) / F.lit(MONTH_DAYS)


def lookback(at: Column) -> Column:
    """Months that a position looks back: wider in the sparse years."""
    return lookback_of(F.year(at))


def lookback_of(year: Column) -> Column:
    return F.when(year <= 2020, 24).when(year <= 2023, 12).otherwise(6)


def month_ends(first: Column, last: Column) -> Column:
    """The last day of each month from the first date's to the last date's."""
    return F.transform(F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month")), F.last_day)


def effective(utterance: Column, publication: Column) -> Column:
    return F.coalesce(utterance, publication)


def place_on_timeline(d: Column, first: Column, n_months: Column) -> Column:
    """0 at the first month, 1 at the last, never beyond."""
    months = (F.year(d) - F.year(first)) * 12 + F.month(d) - F.month(first)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(months, n_months - 1)))


def duration(minutes: Column) -> Column:
    """Seconds under a minute, minutes under an hour, hours under a day, else days."""
    return (
        F.when(minutes < 1, F.format_string("%d sec", F.round(minutes * 60).cast("int")))
        .when(minutes < 60, F.format_string("%d min", F.round(minutes).cast("int")))
        .when(minutes < 600, F.format_string("%.1f hr", minutes / 60))
        .when(minutes < 1440, F.format_string("%.0f hr", minutes / 60))
        .otherwise(F.format_string("%.1f days", minutes / 1440))
    )


def year_fallback(found: Column, text: Column) -> Column:
    """A date, else 1 July of the first year 2000-2029 in the first 400 characters."""
    year = F.regexp_extract(F.substring(text, 1, 400), r"\b(20[0-2]\d)\b", 1)
    return F.coalesce(found, F.when(year != "", F.make_date(year.try_cast("int"), F.lit(7), F.lit(1))))
