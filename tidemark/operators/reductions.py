"""Reductions of samples in windows, as lists of aggregates.

All combine partially before the shuffle. Null values (masked samples) are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reduction(method: str, value: Column, time: Column | None = None, weight: Column | None = None) -> Column:
    """The aggregate of ``none, min, max, sum, average, rms, powN`` (alias it).

    ``sum`` ignores weights; powers are taken of value times weight and divided by the
    sum of weights.
    """
    w = F.when(value.isNotNull(), weight if weight is not None else F.lit(1.0))
    total = F.sum(w)
    weighted = value if weight is None else value * weight
    if method == "none":
        return F.max_by(value, time)
    if method == "min":
        return F.min(value)
    if method == "max":
        return F.max(value)
    if method == "sum":
        return F.sum(value)
    if method in ("average", "mean"):
        return F.sum(weighted) / total
    if method == "rms":
        return F.sqrt(F.sum(weighted * weighted) / total)
    if m := re.fullmatch(r"pow(\d+)", method):
        power = weighted
        for _ in range(int(m[1]) - 1):
            power = power * weighted
        return F.sum(power) / total
    raise ValueError(f"unknown reduction {method!r}")


def reduce_by(df: DataFrame, keys: list[str], value: str, method: str, time: str | None = None, weight: str | None = None, name: str = "value") -> DataFrame:
    column = reduction(method, F.col(value), F.col(time) if time else None, F.col(weight) if weight else None)
    return df.groupBy(*keys).agg(column.alias(name))


def even_share(total: str, count: str, keys: list[str], n: int) -> Column:
    """A section's total divided by (samples of the window) / n."""
    from pyspark.sql import Window

    return F.col(total) / (F.sum(count).over(Window.partitionBy(*keys)) / F.lit(n))


def diurnal(df: DataFrame, keys: list[str], value: str, section: str, n: int, per_bin: bool = False) -> DataFrame:
    """Means by section of the day: ``keys, section, count, value``.

    Every section is divided by (samples of the window) / n, as if sampling were even;
    with ``per_bin`` by its own number of samples. Sums of sections are few, so their
    totals are taken after the first aggregation.
    """
    bins = df.groupBy(*keys, section).agg(F.sum(value).cast("double").alias("total"), F.count(value).alias("count"))
    mean = F.col("total") / F.col("count") if per_bin else even_share("total", "count", keys, n)
    return bins.withColumn("value", mean).drop("total")


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str, strict: bool = False, name: str = "mean") -> DataFrame:
    """Means over a column or area; where the weights sum to zero null, or an error if ``strict``."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    out = df.groupBy(*keys).agg(F.sum(F.col(value) * w).alias("__x"), F.sum(w).alias("__w"))
    mean = F.col("__x") / F.nullif("__w", F.lit(0.0))
    if strict:
        mean = F.when(F.col("__w") == 0, F.raise_error(F.lit("the weights of a mean sum to zero"))).otherwise(mean)
    return out.select(*keys, mean.alias(name))


def area_mean(df: DataFrame, keys: list[str], value: str, area: str, latitude: str | None = None) -> DataFrame:
    """Integrals over an area divided by the whole area of ``df``: ``keys, hemisphere?, mean``.

    With ``latitude`` the hemispheres apart (1 north with the equator, -1 south), each by
    its own area. The areas are one row a hemisphere, joined to the sums.
    """
    side = [F.when(F.col(latitude) >= 0, 1).otherwise(-1).alias("hemisphere")] if latitude else [F.lit(0).alias("hemisphere")]
    placed = df.select("*", *side)
    areas = placed.groupBy("hemisphere").agg(F.sum(area).alias("__area"))
    sums = placed.groupBy(*keys, "hemisphere").agg(F.sum(F.col(value) * F.col(area)).alias("__x"))
    out = sums.join(areas, "hemisphere").select(*keys, "hemisphere", (F.col("__x") / F.nullif("__area", F.lit(0.0))).alias("mean"))
    return out if latitude else out.drop("hemisphere")


def integral_average(df: DataFrame, keys: list[str], value: str, area: str, cells: int) -> DataFrame:
    """Averages of sampled integrals: the sum over all calls by (whole area times calls): ``keys, calls, average``.

    A group whose number of samples is no multiple of the field's ``cells`` is an error.
    """
    out = df.groupBy(*keys).agg(F.sum(F.col(value) * F.col(area)).alias("x"), F.sum(area).alias("a"), F.count("*").alias("n"))
    whole = F.when(F.col("n") % cells != 0, F.raise_error(F.lit("samples are no multiple of the field's cells"))).otherwise(F.col("n") / cells)
    return out.select(*keys, whole.cast("long").alias("calls"), (F.col("x") / F.nullif("a", F.lit(0.0))).alias("average"))


def global_sum(df: DataFrame, keys: list[str], value: str, flavour: str = "plain", name: str = "total", missing: float | None = None) -> DataFrame:
    """Sums over all cells: ``plain``, ``exact`` (order-invariant) or ``decimal`` (two places, exact)."""
    x = F.col(value) if missing is None else F.when(F.col(value) != missing, F.col(value))
    rows = df.withColumn("__v", x)
    if flavour == "exact":
        return exact_sum(rows, keys, "__v", name).select(*keys, name)
    if flavour not in ("plain", "decimal"):
        raise ValueError("the flavour is plain, exact or decimal")
    summed = F.sum(F.col("__v").cast("decimal(18,2)")).cast("double") if flavour == "decimal" else F.sum("__v")
    return rows.groupBy(*keys).agg(summed.alias(name))


def tile_average(df: DataFrame, keys: list[str], value: str, area: str) -> DataFrame:
    """Area-weighted means over tiles; null if the areas sum to zero."""
    a = F.when(F.col(value).isNotNull(), F.col(area))
    return df.groupBy(*keys).agg((F.sum(F.col(value) * a) / F.nullif(F.sum(a), F.lit(0))).alias("value"))


LIMBS = 6
LIMB_BITS = 46
#: Powers of two that the limbs count, most significant first.
SCALES = tuple(math.ldexp(1.0, LIMB_BITS * (2 - n)) for n in range(LIMBS))


#: Values from here on have no limbs.
LARGEST = math.ldexp(SCALES[0], LIMB_BITS - 1)


def limbs(value: Column) -> list[Column]:
    """A number as six signed integers, exactly: value = sum of limb times scale.

    Null, NaN, infinite and too large values have null limbs.
    """
    rest, out = F.abs(value), []
    fine = (rest < F.lit(LARGEST)) & ~F.isnan(rest)
    rest = F.when(fine, rest)
    sign = F.signum(F.when(fine, value)).cast("long")
    for scale in SCALES:
        limb = F.floor(rest / F.lit(scale))
        rest = rest - limb.cast("double") * F.lit(scale)
        out.append(limb * sign)
    return out


def exact_sum(df: DataFrame, keys: list[str], value: str, name: str = "total", with_limbs: bool = False) -> DataFrame:
    """Sums that do not depend on the order of rows: ``keys, name, has_nan, has_overflow, n``.

    Limbs are summed as decimals of 38 digits, so no carry is lost at any row count;
    they are carried and combined once a group. ``n`` counts the values that are not
    null. NaN sets ``has_nan``; a finite value of 2 ** 137 or more sets ``has_overflow``;
    either makes the total null. Infinities add up as usual: one of them is the total,
    both together count as NaN. ``with_limbs`` adds the carried limbs, ``limb0`` (worth
    2 ** 92) to ``limb5``, as decimals.
    """
    x = F.col(value).cast("double")
    parts = [F.sum(part.cast("decimal(20,0)")).alias(f"__limb{n}") for n, part in enumerate(limbs(x))]
    endless = F.abs(x) == F.lit(math.inf)
    flags = [
        F.coalesce(F.bool_or(F.isnan(x)), F.lit(False)).alias("__nan"), F.coalesce(F.bool_or(endless & (x > 0)), F.lit(False)).alias("__up"),
        F.coalesce(F.bool_or(endless & (x < 0)), F.lit(False)).alias("__down"),
        F.coalesce(F.bool_or((F.abs(x) >= F.lit(LARGEST)) & ~endless & ~F.isnan(x)), F.lit(False)).alias("has_overflow"),
    ]
    out = df.groupBy(*keys).agg(*parts, *flags, F.count(x).alias("n"))
    out = out.withColumn("has_nan", F.col("__nan") | (F.col("__up") & F.col("__down")))
    carry, carried = F.lit(0).cast("decimal(38,0)"), []
    radix = F.lit(1 << LIMB_BITS).cast("decimal(20,0)")
    for n in reversed(range(LIMBS)):
        s = (F.coalesce(F.col(f"__limb{n}"), F.lit(0)) + carry).cast("decimal(38,0)")
        rest = (s % radix).cast("decimal(38,0)") if n else s
        carried.append((n, rest))
        carry = ((s - rest) / radix).cast("decimal(38,0)")
    total = F.lit(0.0)
    for n, rest in sorted(carried):
        total = total + rest.cast("double") * F.lit(SCALES[n])
    total = F.when(F.col("__up"), math.inf).when(F.col("__down"), -math.inf).otherwise(total)
    more = [rest.alias(f"limb{n}") for n, rest in sorted(carried)] if with_limbs else []
    fine = ~F.col("has_nan") & ~F.col("has_overflow") & (F.col("n") > 0)
    return out.select(*keys, F.when(fine, total).alias(name), "has_nan", "has_overflow", "n", *more)


def locus(df: DataFrame, keys: list[str], value: str, place: list[str]) -> DataFrame:
    """Least and largest value with their places; of ties the least place."""
    here = F.struct(*place)
    low = F.min(F.struct(F.col(value).alias("v"), here.alias("at")))
    high = F.min(F.struct((-F.col(value)).alias("v"), here.alias("at")))
    kept = df.where(F.col(value).isNotNull())
    out = kept.groupBy(*keys).agg(low.alias("low"), high.alias("high")) if keys else kept.agg(low.alias("low"), high.alias("high"))
    columns = [F.col("low.v").alias("min_value"), (-F.col("high.v")).alias("max_value")]
    for p in place:
        columns += [F.col(f"low.at.{p}").alias(f"min_{p}"), F.col(f"high.at.{p}").alias(f"max_{p}")]
    return out.select(*keys, *columns)


def statistics(df: DataFrame, keys: list[str], value: str, area: str, mask: Column) -> DataFrame:
    """Area, integral, least, largest and number of masked values."""
    v, a = F.when(mask, F.col(value)), F.when(mask, F.col(area))
    return df.groupBy(*keys).agg(
        F.sum(a).alias("area"), F.sum(v * a).alias("integral"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
        F.count_if(~mask).alias("n_masked"),
    )


def checksum(value: Column, missing: Column | None = None) -> Column:
    """Wrapping 64-bit sum of integers, without those equal to ``missing``, as hex digits.

    Integers may be decimals of any size; each is wrapped before it is summed.
    """
    kept = value if missing is None else F.when(value != missing, value)
    around = F.lit(str(1 << 64)).cast("decimal(20,0)")
    wrapped = F.pmod(F.sum(F.pmod(kept.cast("decimal(38,0)"), around).cast("decimal(20,0)")), around)
    high = F.floor(wrapped / F.lit(1 << 32).cast("decimal(20,0)")).cast("long")
    low = (wrapped % F.lit(1 << 32).cast("decimal(20,0)")).cast("long")
    return F.lower(F.concat(F.lpad(F.hex(high), 8, "0"), F.lpad(F.hex(low), 8, "0")))


def double_bits(df: DataFrame, value: str, name: str = "bits") -> DataFrame:
    """The IEEE bits of a double column as a long, in Arrow batches."""

    @F.pandas_udf("long")
    def bits(x: pd.Series) -> pd.Series:
        return pd.Series(x.to_numpy(np.float64).view(np.int64))

    return df.withColumn(name, bits(F.col(value)))
