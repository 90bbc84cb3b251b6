"""Climatologies on time and pressure levels at a model's times and levels, as one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import interpolate_list, intervals
from tidemark.operators.fields import between_records, interpolate_vertical, linear_vertical


def climatology(source: DataFrame, model: DataFrame, keys: list[str], period: int | None = None, vertical: str = "weighted", outside: str = "constant") -> DataFrame:
    """``keys, t, k, value``: ``source(keys, t, top, bottom, q)`` at ``model(keys, t, k, top, bottom)``.

    Time is linear between slices and cyclic with ``period``; without one, a time
    outside the slices is left out. ``weighted`` means by mass over a layer, ``linear``
    interpolates between upper half-levels (``top``), at the model's. Where the model's column reaches beyond the source's,
    ``zero`` counts nothing; ``constant`` stretches the outermost source layers to it, or
    extrapolates the last two half-levels if ``linear``.

    A source layer is missing at a time unless both slices around it hold a value (nulls
    and absent rows are missing); a model layer that touches a missing one is null.

    Slice times are the one short list; they alone are matched by range, columns by key.
    """
    if vertical not in ("weighted", "linear") or outside not in ("constant", "zero"):
        raise ValueError("vertical is weighted or linear, outside constant or zero")
    slices = source.select("t").distinct().withColumn("x", F.col("t"))
    spans = intervals(slices, "t", "x", period)
    if period is None:  # a time at the last slice takes it whole
        last = slices.agg(F.max("t").alias("t1"))
        spans = spans.unionByName(last.select("t1", F.col("t1").alias("x1"), (F.col("t1") + 1).alias("t2"), F.col("t1").alias("x2")))
        spans = spans.withColumn("until", F.when(F.col("x1") == F.col("x2"), F.col("t1")))
    else:
        spans = spans.withColumn("until", F.lit(None).cast("long"))
    spans = spans.withColumns({"s1": F.col("x1"), "s2": F.col("x2"), "a": F.col("t1"), "b": F.col("t2")})
    u = F.pmod(F.col("t"), F.lit(period)) if period is not None else F.col("t")
    placed = interpolate_list(model.select("t").distinct().withColumn("u", u), spans, F.col("u"))
    placed = placed.where("s1 is not null and (until is null or u = until)")
    w = (F.col("u") - F.col("a")) / (F.col("b") - F.col("a"))
    shares = placed.select("t", "s1", "s2", w.alias("part"))
    if period is None:  # the last slice alone is its own second
        shares = shares.withColumn("s2", F.when(F.col("s1") == F.col("s2"), F.lit(None)).otherwise(F.col("s2")))
    columns = [*keys, "t"]
    # linear in time first, at fixed source layers: one column of layers per key and time
    layers = source.select(F.col("t").cast("double").alias("slice"), *keys, "top", "bottom", F.col("q").alias("x"))
    alone = layers.join(shares.where("s2 is null").select("t", F.col("s1").alias("slice")), "slice").drop("slice")
    at = between_records(layers, shares.where("s2 is not null"), [*keys, "top", "bottom"])
    at = at.unionByName(alone).withColumnRenamed("x", "q")
    if vertical == "linear":
        half_level = F.col("top").alias("p")
        wanted = model.select(*columns, "k", half_level)
        if outside == "zero":
            ends = at.groupBy(*columns).agg(F.min("top").alias("least"), F.max("bottom").alias("most"))
            wanted = wanted.join(ends, columns).withColumn("out", (F.col("p") < F.col("least")) | (F.col("p") > F.col("most")))
            found = linear_vertical(at.select(*columns, half_level, "q"), wanted.select(*columns, "k", "p"), columns)
            found = found.join(wanted.select(*columns, "k", "out"), [*columns, "k"])
            return found.select(*columns, "k", F.when(F.col("out"), 0.0).otherwise(F.col("value")).alias("value"))
        return linear_vertical(at.select(*columns, half_level, "q"), wanted, columns)
    if outside == "constant":
        reach = model.groupBy(*columns).agg(F.min("top").alias("m_top"), F.max("bottom").alias("m_bottom"))
        whole = Window.partitionBy(*columns)
        at = at.withColumn("first", F.min("top").over(whole)).withColumn("last", F.max("bottom").over(whole)).join(reach, columns)
        top = F.when(F.col("top") == F.col("first"), F.least("top", "m_top")).otherwise(F.col("top"))
        bottom = F.when(F.col("bottom") == F.col("last"), F.greatest("bottom", "m_bottom")).otherwise(F.col("bottom"))
        at = at.select(*columns, top.alias("top"), bottom.alias("bottom"), "q")
    return interpolate_vertical(at, model, columns)


def months_between_years(source: DataFrame, times: DataFrame, keys: list[str]) -> DataFrame:
    """``t, keys, x``: monthly slices of years that do not follow one another, at ``times(t)``.

    ``source(year, month, day, keys, x)`` has whole years of twelve slices, on ``day`` of each
    month (28 at most; the same in all years); ``t`` are timestamps. A time lies between
    two months, of which those before January are December of the year before, and each
    month lies between the last year that has slices and the next: four slices, weighted by
    both. Between slices that follow one another by a month, as within a year, the
    weights of the years fall away. All slices with a weight must hold a value, else ``x`` is
    null (no row, if none does); times before the first slice or after the last have no row.

    The slices' dates are a short list (twelve a year); fields are joined by slice.
    """
    dates = source.select("year", "month", "day").distinct().collect()
    if not dates:
        return times.select("t").where("false").crossJoin(source.select(*keys, F.col("x").cast("double").alias("x")))
    days = {r.month: r.day for r in dates}
    if len({(r.month, r.day) for r in dates}) != 12 or max(days.values()) > 28:
        raise ValueError("a climatology has one slice a month, on the same day (28 at most) of every year")
    years = sorted({r.year for r in dates})
    of_month = F.array(*[F.lit(days[m]) for m in range(1, 13)])
    t = times.select("t").distinct().where(F.col("t").isNotNull())
    y, m = F.year("t"), F.month("t")
    moment = lambda count: F.make_timestamp_ntz(
        F.floor(count / 12).cast("int"), (F.pmod(count, F.lit(12)) + 1).cast("int"), F.element_at(of_month, (F.pmod(count, F.lit(12)) + 1).cast("int")), F.lit(0), F.lit(0), F.lit(0)
    )
    t = t.withColumn("t", F.col("t").cast("timestamp_ntz")).withColumn("n", y * 12 + m - 1)
    t = t.withColumn("n", F.when(F.col("t") < moment(F.col("n")), F.col("n") - 1).otherwise(F.col("n")))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")).cast("double")
    w3 = (seconds(F.col("t")) - seconds(moment(F.col("n")))) / (seconds(moment(F.col("n") + 1)) - seconds(moment(F.col("n"))))
    first, last = moment(F.lit(years[0] * 12)), moment(F.lit(years[-1] * 12 + 11))
    t = t.where((F.col("t") >= first) & (F.col("t") <= last)).withColumn("w3", w3)
    parts = F.array(F.struct(F.col("n").alias("at"), (1 - F.col("w3")).alias("w")), F.struct((F.col("n") + 1).alias("at"), F.col("w3").alias("w")))
    rows = t.select("t", F.explode(parts).alias("p")).select("t", "p.at", "p.w")
    # the years around each month
    year = F.floor(F.col("at") / 12).cast("int")
    known = F.array(*[F.lit(x) for x in years])
    before = F.array_max(F.filter(known, lambda k: k <= year))
    after = F.array_min(F.filter(known, lambda k: k >= year))
    rows = rows.withColumns({"low": F.coalesce(before, after), "high": F.coalesce(after, before), "month": (F.pmod(F.col("at"), F.lit(12)) + 1).cast("int")})
    at_year = lambda c: seconds(moment(F.col(c) * 12 + F.col("month") - 1))
    share = F.when(F.col("low") == F.col("high"), 0.0).otherwise((seconds(moment(F.col("at"))) - at_year("low")) / F.nullif(at_year("high") - at_year("low"), F.lit(0.0)))
    both = F.array(F.struct(F.col("low").alias("year"), ((1 - share) * F.col("w")).alias("w")), F.struct(F.col("high").alias("year"), (share * F.col("w")).alias("w")))
    wanted = rows.select("t", "month", F.explode(both).alias("p")).select("t", "month", "p.year", "p.w").groupBy("t", "month", "year").agg(F.sum("w").alias("w"))
    wanted = wanted.where("w > 0")
    need = wanted.groupBy("t").agg(F.count("*").alias("need"))
    found = source.where(F.col("x").isNotNull()).select("year", "month", *keys, F.col("x").cast("double").alias("x")).join(wanted, ["year", "month"])
    sums = found.groupBy("t", *keys).agg(F.sum(F.col("x") * F.col("w")).alias("x"), F.count("*").alias("n")).join(need, "t")
    return sums.select("t", *keys, F.when(F.col("n") == F.col("need"), F.col("x")).alias("x"))
