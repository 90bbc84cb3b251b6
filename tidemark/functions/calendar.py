"""Calendars as column expressions on day numbers and seconds.

A date is days since 0001-01-01 of its calendar (0 on that day) and seconds of the
day. Calendars: gregorian, julian, noleap (365 days), thirty_day (12 months of 30).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALENDARS = ("gregorian", "julian", "noleap", "thirty_day")
LENGTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
BEFORE = tuple(sum(LENGTHS[:m]) for m in range(12))


def _check(calendar: str) -> None:
    if calendar not in CALENDARS:
        raise ValueError(f"unknown calendar {calendar!r}")


def leap_year(year: Column, calendar: str) -> Column:
    _check(calendar)
    by_four = F.pmod(year, F.lit(4)) == 0
    if calendar == "gregorian":
        return by_four & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0))
    return by_four if calendar == "julian" else F.lit(False)


def days_in_month(year: Column, month: Column, calendar: str) -> Column:
    if calendar == "thirty_day":
        return F.lit(30)
    length = F.element_at(F.array(*[F.lit(x) for x in LENGTHS]), month.cast("int"))
    return length + F.when(leap_year(year, calendar) & (month == 2), 1).otherwise(0)


def days_in_year(year: Column, calendar: str) -> Column:
    if calendar == "thirty_day":
        return F.lit(360)
    return F.lit(365) + leap_year(year, calendar).cast("int")


def _div(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def days_before_year(year: Column, calendar: str) -> Column:
    y = year - 1
    if calendar == "thirty_day":
        return y * 360
    days = y * 365
    if calendar == "julian":
        days = days + _div(y, 4)
    if calendar == "gregorian":
        days = days + _div(y, 4) - _div(y, 100) + _div(y, 400)
    return days


def day_of_year(year: Column, month: Column, day: Column, calendar: str) -> Column:
    if calendar == "thirty_day":
        return (month - 1) * 30 + day
    before = F.element_at(F.array(*[F.lit(x) for x in BEFORE]), month.cast("int"))
    return before + F.when(leap_year(year, calendar) & (month > 2), 1).otherwise(0) + day


def set_date(year: Column, month: Column, day: Column, calendar: str, strict: bool = True) -> Column:
    """Day number of a date; an invalid date is an error, or null if not ``strict``."""
    _check(calendar)
    fine = month.between(1, 12) & (day >= 1) & (day <= days_in_month(year, F.greatest(F.lit(1), F.least(F.lit(12), month)), calendar)) & (year >= 1)
    number = days_before_year(year, calendar) + day_of_year(year, month, day, calendar) - 1
    text = F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string"))
    bad = F.raise_error(F.concat(F.lit(f"not a date of the {calendar} calendar: "), text)).cast("long")
    return F.when(fine, number.cast("long")).otherwise(bad if strict else F.lit(None).cast("long"))


def parse_date(text: Column, calendar: str, strict: bool = True) -> tuple[Column, Column]:
    """Day number and second of ``YYYY-MM-DD hh:mm:ss`` (parts from the hour on may lack), in any calendar."""
    part = lambda n: F.try_element_at(F.split(F.trim(text), "[-T: ]+"), F.lit(n)).try_cast("int")
    seconds = F.coalesce(part(4), F.lit(0)) * 3600 + F.coalesce(part(5), F.lit(0)) * 60 + F.coalesce(part(6), F.lit(0))
    return set_date(part(1), part(2), part(3), calendar, strict), seconds.cast("long")


def increment_time(days: Column, seconds: Column, more_days: Column, more_seconds: Column) -> tuple[Column, Column]:
    """A time and a span after it (or before, if negative); a time before zero is an error."""
    total = (days + more_days) * 86400 + seconds + more_seconds
    total = F.when(total < 0, F.raise_error(F.lit("a time before zero")).cast("long")).otherwise(total)
    return _div(total, 86400), F.pmod(total, F.lit(86400))


def time_as_real(days: Column, seconds: Column, ticks: Column | None = None, ticks_a_second: int = 1) -> Column:
    """Seconds of a time with its ticks, as a double."""
    real = days.cast("double") * 86400 + seconds
    return real if ticks is None else real + ticks / F.lit(float(ticks_a_second))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` has it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _parts(year: Column, month: Column, day: Column) -> Column:
    return F.struct(year.cast("long").alias("year"), month.cast("long").alias("month"), day.cast("long").alias("day"))


def _in_year(year: Column, rest: Column, calendar: str) -> Column:
    """The date ``rest`` days after the start of a year."""
    leap = leap_year(year, calendar).cast("int")
    starts = F.array(*[F.lit(b) + (leap if m > 1 else 0) for m, b in enumerate(BEFORE)])
    return let(starts, lambda s: let(F.size(F.filter(s, lambda x: x <= rest)), lambda m: _parts(year, m, rest - F.element_at(s, m) + 1)))


def get_date(days: Column, calendar: str) -> tuple[Column, Column, Column]:
    """Year, month and day of a day number."""
    _check(calendar)
    if calendar == "gregorian":
        date = F.date_add(F.to_date(F.lit("0001-01-01")), days.cast("int"))
        return F.year(date).cast("long"), F.month(date).cast("long"), F.dayofmonth(date).cast("long")
    if calendar == "thirty_day":
        rest = F.pmod(days, F.lit(360))
        return _div(days, 360) + 1, (_div(rest, 30) + 1).cast("long"), (F.pmod(rest, F.lit(30)) + 1).cast("long")
    if calendar == "noleap":
        date = let(days, lambda n: _in_year(_div(n, 365) + 1, F.pmod(n, F.lit(365)), calendar))
    else:
        # four years have 1461 days, the last of them one more than the others
        date = let(days, lambda n: let(F.pmod(n, F.lit(1461)), lambda r: let(F.least(_div(r, 365), F.lit(3)), lambda k: _in_year(
            _div(n, 1461) * 4 + k + 1, r - k * 365, calendar))))
    return tuple(F.when(days.isNotNull(), date[part]) for part in ("year", "month", "day"))


def increment_months(year: Column, month: Column, day: Column, months: int, calendar: str, strict: bool = True) -> Column:
    """Day number after some months (before, if negative); a day that the month lacks is an error, not clamped.

    It is null if not ``strict``.
    """
    count = year * 12 + month - 1 + months
    return set_date(_div(count, 12), F.pmod(count, F.lit(12)) + 1, day, calendar, strict)


def calendar_time(value: Column, unit: str, since: tuple[int, int, int], calendar: str) -> tuple[Column, Column]:
    """Day number and second of ``value`` units since a date.

    Fractions of months and years are of that month's or year's length; seconds are
    truncated.
    """
    y, m, d = (F.lit(x) for x in since)
    base = set_date(y, m, d, calendar)
    whole = F.floor(value)
    part = value - whole
    if unit == "months":
        count = y * 12 + m - 1 + whole
        year, month = _div(count, 12), F.pmod(count, F.lit(12)) + 1
        exact = set_date(year, month, d, calendar) + part * days_in_month(year, month, calendar)
    elif unit == "years":
        exact = set_date(y + whole, m, d, calendar) + part * days_in_year(y + whole, calendar)
    else:
        per_day = {"days": 1, "hours": 24, "minutes": 1440, "seconds": 86400}[unit]
        exact = base + value / per_day
    days = F.floor(exact)
    return days.cast("long"), F.floor((exact - days) * 86400).cast("long")


def difference(a: Column, b: Column) -> Column:
    """Times have no sign: the absolute difference."""
    return F.abs(a - b)


def year_fraction(days: Column, calendar: str) -> Column:
    year = get_date(days, calendar)[0]
    return (days - days_before_year(year, calendar)) / days_in_year(year, calendar)


MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in MONTHS]), month.cast("int"))


def date_text(days: Column, seconds: Column, calendar: str) -> Column:
    """``YYYYMMDD.hhmmss``."""
    y, m, d = get_date(days, calendar)
    return F.format_string("%04d%02d%02d.%02d%02d%02d", y, m, d, _div(seconds, 3600), _div(F.pmod(seconds, F.lit(3600)), 60), F.pmod(seconds, F.lit(60)))
