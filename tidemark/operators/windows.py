"""Right-closed time windows: a sample at a window's end belongs to that window.

Times are microseconds (long) unless a function says timestamp. Everything is a column
expression, so windows add no shuffle of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
UNITS = {"seconds": SECOND, "minutes": 60 * SECOND, "hours": 3600 * SECOND, "days": 86400 * SECOND}
CALENDAR_UNITS = {"months": 1, "years": 12}


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a timestamp of either kind, in UTC."""
    return F.unix_micros(time.cast("timestamp"))


def floor_div(a: Column, b: int) -> Column:
    return (a - F.pmod(a, F.lit(b))) / F.lit(b)


def window_number(time: Column, base: int, freq: int) -> Column:
    """The number n of the window ((n-1) freq, n freq] after ``base`` that holds ``time``."""
    shifted = time - F.lit(base - freq + 1)
    return floor_div(shifted, freq).cast("long")


def window_end(time: Column, base: int, freq: int) -> Column:
    return F.lit(base) + window_number(time, base, freq) * F.lit(freq)


def calendar_end(time: Column, months: int) -> Column:
    """End of the right-closed window of ``months`` calendar months, counted from year 0."""
    before = time - F.expr("interval 1 microsecond")
    count = F.year(before) * 12 + F.month(before) - 1
    last = count - F.pmod(count, F.lit(months)) + F.lit(months)
    start = F.make_date(floor_div(last, 12).cast("int"), (F.pmod(last, F.lit(12)) + 1).cast("int"), F.lit(1))
    return start.cast("timestamp_ntz")


def clock_end(time: Column, unit: str) -> Column:
    """End of the clock-aligned day, hour or month that holds ``time``, right-closed."""
    start = F.date_trunc(unit, time - F.expr("interval 1 microsecond"))
    step = {"day": "interval 1 day", "hour": "interval 1 hour", "month": "interval 1 month", "year": "interval 1 year"}[unit]
    return (start + F.expr(step)).cast("timestamp_ntz")


class Months(int):
    """A span of whole calendar months, where other spans are microseconds."""


def months_end(time: Column, base: int, months: int) -> Column:
    """End (microseconds) of the window of calendar months after ``base`` that holds ``time``.

    Ends fall on the base's day of the month and time of day; that day is 28 at most.
    """
    import datetime

    start = datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=base)
    if start.day > 28:
        raise ValueError("windows of months begin on day 28 or before")
    offset = base - int((datetime.datetime(start.year, start.month, 1) - datetime.datetime(1970, 1, 1)) / datetime.timedelta(microseconds=1))
    at = F.timestamp_micros(time - F.lit(offset + 1)).cast("timestamp_ntz")
    n = F.year(at) * 12 + F.month(at) - (start.year * 12 + start.month)
    ahead = n - F.pmod(n, F.lit(months)) + F.lit(months) + F.lit(start.year * 12 + start.month - 1)
    first = F.make_date(floor_div(ahead, 12).cast("int"), (F.pmod(ahead, F.lit(12)) + 1).cast("int"), F.lit(1))
    return F.unix_date(first).cast("long") * F.lit(86400 * SECOND) + F.lit(offset)


def span_end(time: Column, base: int, freq: int) -> Column:
    """``window_end`` or, for ``Months``, ``months_end``."""
    return months_end(time, base, int(freq)) if isinstance(freq, Months) else window_end(time, base, freq)


def later(time: int, span: int) -> int:
    """A time (microseconds) and a span after it."""
    import datetime

    if not isinstance(span, Months):
        return time + span
    start = datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=time)
    n = start.year * 12 + start.month - 1 + int(span)
    moved = start.replace(year=n // 12, month=n % 12 + 1)
    return time + int((moved - start) / datetime.timedelta(microseconds=1))


@dataclass(frozen=True)
class Phase:
    """Windows of ``freq`` from ``start`` to ``stop`` (microseconds)."""

    start: int
    stop: int
    freq: int


def phase_end(time: Column, phases: list[Phase]) -> Column:
    """Window end under successive frequencies; null outside every phase."""
    out = F.lit(None).cast("long")
    for p in reversed(phases):
        inside = (time > p.start) & (time <= p.stop)
        out = F.when(inside, F.least(span_end(time, p.start, p.freq), F.lit(p.stop))).otherwise(out)
    return out


def time_bounds(end: Column, freq: int, instant: bool = False) -> tuple[Column, Column, Column]:
    """Time written, lower and upper bound: the end of an instant, the middle of a mean."""
    start = end - F.lit(freq)
    middle = start + F.lit(freq // 2)
    return (end if instant else middle), start, end


def skipped_steps(df: DataFrame, cell: list[str], time: str, step: int) -> DataFrame:
    """Rows whose previous sample of the same cell lies more than ``step`` back."""
    last = F.lag(time).over(Window.partitionBy(*cell).orderBy(time))
    out = df.withColumn("gap", F.col(time) - last)
    return out.where(F.col("gap") > step)


def repeat_alarm(time: Column, freq: int, width: int) -> Column:
    """Whether ``time`` is in the last or first half ``width`` around a multiple of ``freq``."""
    phase = F.pmod(time, F.lit(freq))
    return (phase * 2 <= width) | ((F.lit(freq) - phase) * 2 < width)


def interval_alarm(time: Column, step: int, alarm: Column) -> Column:
    """Whether ``time`` is within half a ``step`` of ``alarm``."""
    return F.abs(time - alarm) * 2 <= step


def section(time: Column, n: int) -> Column:
    """Diurnal section 1..n of the time of day."""
    of_day = F.pmod(time, F.lit(86400 * SECOND))
    return (floor_div(of_day * F.lit(n), 86400 * SECOND) + 1).cast("int")


#: File name codes, coarsest first, with what they print (fixed values).
CODES = (("yr", "year"), ("mo", "month"), ("dy", "day"), ("hr", "hour"), ("mi", "minute"), ("sc", "second"))


def file_name(template: str, time: Column) -> Column:
    """``template`` with codes such as ``%4yr%2mo%2dy%2hr`` filled from ``time``.

    The digit is the width. A code without its coarser neighbour counts on from what is
    there: days without months are days of the year, hours without days hours since then.
    """
    import re

    used = [c for _, c in re.findall(r"%(\d)(yr|mo|dy|hr|mi|sc)", template)]
    coarser = None
    values: dict[str, Column] = {}
    for code, field in CODES:
        if code not in used:
            continue
        if code == "dy" and "mo" not in used:
            value = F.dayofyear(time)
        elif code == "hr" and coarser in ("mo", "yr"):
            days = F.dayofmonth(time) - 1 if coarser == "mo" else F.dayofyear(time) - 1
            value = days * 24 + F.hour(time)
        elif code == "mi" and coarser != "hr" and coarser is not None:
            value = F.hour(time) * 60 + F.minute(time)
        elif code == "sc" and coarser != "mi" and coarser is not None:
            value = F.minute(time) * 60 + F.second(time)
        else:
            value = F.extract(F.lit(field), time).cast("int")
        values[code], coarser = value.cast("int"), code
    parts, at = [], 0
    for m in re.finditer(r"%(\d)(yr|mo|dy|hr|mi|sc)", template):
        parts += [F.lit(template[at : m.start()]), F.lpad(values[m[2]].cast("string"), int(m[1]), "0")]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))
