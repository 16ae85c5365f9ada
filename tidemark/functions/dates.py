"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def month_end(d: Column) -> Column:
    """Last day of the month."""
    return F.last_day(d)


def week_friday(d: Column) -> Column:
    """Friday that closes the week of ``d`` (a Friday closes its own week)."""
    return F.next_day(F.date_sub(d, 1), "FRI")


def iso_week(d: Column) -> Column:
    """``YYYY-Www`` with the ISO year, which differs from the calendar year at year ends."""
    year = F.extract(F.lit("YEAROFWEEK"), d).cast("string")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def week_index(d: Column) -> Column:
    """Running number of the ISO week, consecutive across years (1970-01-05 is a Monday)."""
    return F.floor(F.datediff(d, F.lit("1970-01-05").cast("date")) / 7).cast("bigint")


def vintage(as_of: Column) -> Column:
    """Half-yearly release in force: October, April, or last year's October."""
    return (
        F.when(F.month(as_of) >= 10, F.concat(F.lit("Oct "), F.year(as_of)))
        .when(F.month(as_of) >= 4, F.concat(F.lit("Apr "), F.year(as_of)))
        .otherwise(F.concat(F.lit("Oct "), F.year(as_of) - 1))
    )


def vintage_age(as_of: Column) -> Column:
    """Months since the release in force."""
    return F.when(F.month(as_of) >= 10, F.month(as_of) - 10).when(F.month(as_of) >= 4, F.month(as_of) - 4).otherwise(
        F.month(as_of) + 2
    )
