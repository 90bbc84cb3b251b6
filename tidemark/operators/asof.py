"""As-of joins that interpolate in time, and searches in sorted axes.

An as-of join unions both sides and carries the last and next reference along the time
order of each key, so its cost is one sort per key and nothing is broadcast. Where the
reference is one short list for all rows, a join on the list's intervals is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_linear(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, name: str = "interpolated") -> DataFrame:
    """``left`` with ``right``'s value interpolated at its times; null outside the range.

    A time at the last reference takes its value. Both references must be valid.
    """
    point = F.struct(F.col(time).alias("t"), F.col(value).alias("x"))
    a = left.withColumn("__point", F.lit(None).cast(f"struct<t:{dict(right.dtypes)[time]},x:{dict(right.dtypes)[value]}>")).withColumn("__left", F.lit(True))
    b = right.select(*keys, time, point.alias("__point"), F.lit(False).alias("__left"))
    rows = a.unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(time, F.col("__left"))
    back = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col("__left"))
    unbounded = (Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__low", F.last("__point", True).over(order.rowsBetween(*unbounded)))
    rows = rows.withColumn("__high", F.last("__point", True).over(back.rowsBetween(*unbounded)))
    low, high = F.col("__low"), F.col("__high")
    w = (F.col(time) - low["t"]) / (high["t"] - low["t"])
    out = F.when(low["t"] == high["t"], low["x"]).otherwise((1 - w) * low["x"] + w * high["x"])
    return rows.withColumn(name, out).where("__left").drop("__left", "__point", "__low", "__high")


def intervals(axis: DataFrame, time: str, value: str, period: int | None = None) -> DataFrame:
    """``(t1, x1, t2, x2)`` between neighbours of one list; with a period, around its end too.

    The window orders the reference list, which is short, not the rows joined to it.
    """
    order = Window.orderBy(time)
    inner = axis.select(F.col(time).alias("t1"), F.col(value).alias("x1"), F.lead(time).over(order).alias("t2"), F.lead(value).over(order).alias("x2"))
    inner = inner.where("t2 is not null")
    if period is None:
        return inner
    ends = axis.agg(F.min(F.struct(F.col(time).alias("t"), F.col(value).alias("x"))).alias("a"), F.max(F.struct(F.col(time).alias("t"), F.col(value).alias("x"))).alias("b"))
    after = ends.select(F.col("b.t").alias("t1"), F.col("b.x").alias("x1"), (F.col("a.t") + period).alias("t2"), F.col("a.x").alias("x2"))
    before = ends.select((F.col("b.t") - period).alias("t1"), F.col("b.x").alias("x1"), F.col("a.t").alias("t2"), F.col("a.x").alias("x2"))
    return inner.unionByName(after).unionByName(before)


MOST_INTERVALS = 10_000


def constants(values: list) -> Column:
    """Numbers (or nulls) as one array of doubles that the planner folds, whatever its length."""
    return F.split(F.lit(",".join("" if v is None else repr(float(v)) for v in values)), ",").try_cast("array<double>")


def points_upto(axis: list[float], value: Column) -> Column:
    """How many points of an increasing axis are at most ``value`` (int; null counts none).

    The axis is one array in the plan, and a row halves it log2 times: a sum of powers of
    two, each added if the point there is still at most the value.
    """
    n = len(axis)
    if not n:
        return F.lit(0)
    points, powers = constants(axis), F.lit([1 << p for p in reversed(range(n.bit_length()))])

    def step(at: Column, power: Column) -> Column:
        ahead = at + power
        return F.when((ahead <= n) & (F.element_at(points, F.least(ahead, F.lit(n))) <= value), ahead).otherwise(at)

    return F.aggregate(powers, F.lit(0), step)


def interpolate_list(df: DataFrame, spans: DataFrame, time: Column, name: str = "interpolated") -> DataFrame:
    """Interpolate at ``time`` in a short list's intervals; rows outside get null.

    The list's columns become arrays in the plan, searched by halving, if it has at most
    ``MOST_INTERVALS`` rows (checked); use ``asof_linear`` beyond.
    """
    if spans.count() > MOST_INTERVALS:
        raise ValueError("too many intervals to broadcast: use asof_linear")
    t = F.col("__t")
    rows = sorted((r for r in spans.collect() if r.t1 is not None and r.t2 is not None), key=lambda r: r.t1)
    if any(a.t2 > b.t1 for a, b in zip(rows, rows[1:])):
        raise ValueError("intervals overlap")
    held = df.withColumn("__t", time).withColumn("__n", points_upto([r.t1 for r in rows], time))
    inside = (F.col("__n") > 0) & (t < F.element_at(constants([r.t2 for r in rows] or [0.0]), F.greatest(F.col("__n"), F.lit(1))))
    kinds = dict(spans.dtypes)
    for c in spans.columns:
        own = F.element_at(constants([r[c] for r in rows]), F.greatest(F.col("__n"), F.lit(1))) if rows else F.lit(None)
        held = held.withColumn(c, F.when(inside, own).cast(kinds[c]))
    joined = held.drop("__n")
    w = (t - F.col("t1")) / (F.col("t2") - F.col("t1"))
    return joined.withColumn(name, (1 - w) * F.col("x1") + w * F.col("x2")).drop("__t", "t1", "x1", "t2", "x2")


def interpolate_modulo(points: list[tuple[float, float]], time: Column, period: Column) -> Column:
    """The value of a short cyclic list of ``(time, value)`` at ``time``, whatever the row's own period.

    So a list of days of the month holds for months of any length: behind the last point
    comes the first one of the next period. Times and points count from the period's
    begin; points behind a row's period are an error of that row.
    """
    points = sorted(points)
    if len(points) < 2 or len(points) > MOST_INTERVALS:
        raise ValueError(f"two points to {MOST_INTERVALS} make a list")
    at, values = constants([t for t, _ in points]), constants([x for _, x in points])
    n, first, last = len(points), points[0][0], points[-1][0]
    k = points_upto([t for t, _ in points], time)
    item = lambda a, place: F.element_at(a, F.least(F.greatest(place, F.lit(1)), F.lit(n)))
    inner = (time - item(at, k)) / (item(at, k + 1) - item(at, k))
    round_gap = period - (last - first)
    outer = F.when(k >= n, time - last).otherwise(time + period - last) / round_gap
    inside = (k >= 1) & (k < n)
    low, high = F.when(inside, item(values, k)).otherwise(points[-1][1]), F.when(inside, item(values, k + 1)).otherwise(points[0][1])
    w = F.when(inside, inner).otherwise(outer)
    late = F.concat(F.lit("a point lies behind a period of "), period.cast("string"))
    return F.when(period <= last, F.raise_error(late).cast("double")).otherwise((1 - w) * low + w * high)


def in_month(time: Column) -> tuple[Column, Column]:
    """Days since the begin of a timestamp's month, and the month's length in days."""
    t = time.cast("timestamp_ntz")
    begin = F.date_trunc("month", t).cast("timestamp_ntz")
    micros_of = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros_of(t) - micros_of(begin)) / F.lit(86_400_000_000.0), F.dayofmonth(F.last_day(t)).cast("double")


def loop_time(time: Column, begin: int, end: int) -> Column:
    """``time`` moved by whole periods into [begin, end)."""
    if begin >= end:
        raise ValueError("a time loop ends after it begins")
    return F.pmod(time - F.lit(begin), F.lit(end - begin)) + F.lit(begin)


def loop_date(time: Column, begin: str, end: str) -> Column:
    """A timestamp moved into the loop [begin, end) by years, so that months and days stay.

    The leap-year correction: both ends are the same day and time of a year. February 29
    becomes the 28th in years without it.
    """
    first, last = (F.to_timestamp_ntz(F.lit(x)) for x in (begin, end))
    if begin[4:] != end[4:] or begin >= end:
        raise ValueError("a loop of dates has whole years")
    years = int(end[:4]) - int(begin[:4])

    def in_year(year: Column) -> Column:
        return (time.cast("timestamp_ntz") + F.make_ym_interval(year - F.year(time), F.lit(0))).cast("timestamp_ntz")

    moved = in_year(F.lit(int(begin[:4])) + F.pmod(F.year(time) - int(begin[:4]), F.lit(years)))
    return F.when(moved < first, in_year(F.year(last))).otherwise(moved)


def mid_weight(current: Column, half: Column, other_half: Column) -> tuple[Column, Column]:
    """Weight of the second period and whether it is the next one, between mid-points.

    ``current`` counts from the period's start, ``half`` is half its length and
    ``other_half`` half the neighbour's: the next's after the middle, else the last's.
    """
    later = current >= half
    weight = F.when(later, (current - half) / (half + other_half)).otherwise((current + other_half) / (half + other_half))
    return weight, later


def nearest_index(value: Column, axis: list[float]) -> Column:
    """1-based index of the nearest point of an increasing axis; ties go to the higher."""
    return points_upto([(a + b) / 2 for a, b in zip(axis, axis[1:])], value) + 1


def fractional_index(value: Column, axis: list[float]) -> Column:
    """1-based fractional index in an increasing axis; -1 outside."""
    points, n = constants(axis), len(axis)
    low = F.least(F.greatest(points_upto(axis, value), F.lit(1)), F.lit(n - 1))
    a, b = F.element_at(points, low), F.element_at(points, low + 1)
    return F.when((value >= axis[0]) & (value <= axis[-1]), low + (value - a) / (b - a)).otherwise(-1.0)


def bridge(past: DataFrame, now: DataFrame, future: DataFrame, time: str) -> DataFrame:
    """One reference of three: the last slice before ``now`` and the first after are added.

    Slices of the neighbours that overlap ``now`` are dropped. Bounds are aggregates of
    one row each.
    """
    span = now.agg(F.min(time).alias("__a"), F.max(time).alias("__b"))
    before = past.crossJoin(span).where(F.col(time) < F.col("__a")).drop("__a", "__b")
    after = future.crossJoin(span).where(F.col(time) > F.col("__b")).drop("__a", "__b")
    return before.unionByName(now).unionByName(after)
