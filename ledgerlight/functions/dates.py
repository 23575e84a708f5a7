"""Dates, months and two-year cycles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, _c, blank


def effective_date(tran: C, filed: C) -> Column:
    return F.coalesce(_c(tran), _c(filed))


def month(d: C) -> Column:
    return F.date_format(_c(d), "yyyy-MM")


def year_or_undated(d: C) -> Column:
    """The year, 0 without a date."""
    return F.coalesce(F.year(_c(d)), F.lit(0))


def district_era(year: C) -> Column:
    y = _c(year)
    return F.when(y < 2012, "2002-2010").when(y < 2022, "2012-2020").otherwise("2022-")


def months_between(start: C, end: C) -> Column:
    """All months from one to the other, both included, as yyyy-MM."""
    first, last = F.trunc(_c(start), "month"), F.trunc(_c(end), "month")
    made = F.transform(F.sequence(first, last, F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))
    return F.when(first <= last, made).otherwise(F.array().cast("array<string>"))


def cycle(d: C) -> Column:
    """The even year whose cycle (December two years before to November) holds the date."""
    y = F.year(_c(d))
    return (y + y % 2 + F.when((F.month(_c(d)) == 12) & (y % 2 == 0), 2).otherwise(0)).cast("int")


def cycle_start(year: C) -> Column:
    return F.make_date(_c(year) - 2, F.lit(12), F.lit(1))


def cycle_end(year: C) -> Column:
    return F.make_date(_c(year), F.lit(11), F.lit(30))


def cycle_month(d: C) -> Column:
    """1 for December that opens the cycle, 24 for November that ends it."""
    d = _c(d)
    return ((F.year(d) - (cycle(d) - 2)) * 12 + F.month(d) - 11).cast("int")


def local_date(instant: C, zone: str = "America/Los_Angeles") -> Column:
    """The calendar date of a UTC instant in a zone."""
    return F.to_date(F.from_utc_timestamp(_c(instant), zone))


def primary_date(year: C) -> Column:
    """The third Tuesday in May."""
    return F.date_add(F.next_day(F.make_date(_c(year), F.lit(4), F.lit(30)), "Tue"), 14)


def parse_date(x: C, formats: tuple[str, ...] = ("yyyy-MM-dd", "MM/dd/yyyy", "MM/dd/yyyy hh:mm a", "yyyy-MM-dd HH:mm:ss")) -> Column:
    """The first format that parses, else null."""
    s = F.trim(blank(x))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(s, F.lit(f))) for f in formats])
