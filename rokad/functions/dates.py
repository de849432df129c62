"""Fiscal-year labels and the eight statement date formats."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month spellings accepted on statements.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
DATE_SHAPE = r"^(\d{1,4})[/\-. ](\d{1,2}|[A-Za-z]{3,4})[/\-. ](\d{1,4})$"


def fy_start(date: Column) -> Column:
    """First calendar year of the April-to-March year holding the date."""
    return F.year(date) - F.when(F.month(date) < 4, 1).otherwise(0)


def fy_label(start: Column) -> Column:
    """2026 -> '2026-27'."""
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def fy_start_date(start: Column) -> Column:
    return F.make_date(start, F.lit(4), F.lit(1))


def fy_end_date(start: Column) -> Column:
    return F.make_date(start + 1, F.lit(3), F.lit(31))


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def _month_number(text: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair]), F.lower(text))


def _number(field: Column) -> Column:
    """Field as int; an empty one is not tried, since a cast that fails costs as much as a hundred that succeed."""
    return F.when(field != "", field).try_cast("int")


def date_text(raw: Column) -> Column:
    """Statement cell without a time of day."""
    s = F.trim(raw)
    return F.trim(F.when(s.contains(":"), F.regexp_replace(s, r"[ T]\d{1,2}:.*$", "")).otherwise(s))


def date_fields(part: Column) -> list[Column]:
    """The three fields of a date's text, empty where it has not the shape of a date."""
    return [F.regexp_extract(part, DATE_SHAPE, i) for i in (1, 2, 3)]


def date_numbers(a: Column, b: Column, c: Column, fmt: Column) -> list[Column]:
    """Year, month and day of three fields under the declared format."""
    named = b.rlike("^[A-Za-z]")
    iso = ~named & (fmt == "yyyy-MM-dd")
    us = ~named & (fmt == "MM/dd/yyyy")
    short = _number(F.when(iso, a).otherwise(c))
    year = (
        F.when(iso | (short > 99), short)
        .when(short >= 70, short + 1900)
        .otherwise(short + 2000)
    )
    month = (
        F.when(named, _month_number(b)).when(us, _number(a)).otherwise(_number(b))
    )
    day = _number(F.when(iso, c).when(us, b).otherwise(a))
    return [year, month, day]


def date_of(year: Column, month: Column, day: Column) -> Column:
    """Date of three numbers; null for missing numbers or impossible dates."""
    y, m, d = (F.lpad(x.cast("string"), width, "0") for x, width in ((year, 4), (month, 2), (day, 2)))
    text = F.concat(y, F.lit("-"), m, F.lit("-"), d)
    usable = month.between(1, 12) & day.between(1, 31)
    return F.when(usable, text.try_cast("date"))


def parse_date(raw: Column, fmt: Column) -> Column:
    """Statement cell to date under the declared format; null for blank, malformed or impossible dates."""
    return date_of(*date_numbers(*date_fields(date_text(raw)), fmt))
