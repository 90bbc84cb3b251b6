"""Saturation pressures from a table, and humidities at saturation by group of values.

The table is made from a formula on the driver (some thousand steps of temperature, three
numbers a step) and is three constant arrays of the plan; a look-up is one index and a
parabola in the row. Values outside the table make the whole group they belong to
missing (``MISSING``), as one call that holds a bad value fails as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.physics import COLDEST, EPS, HLV, HOTTEST, ICE_TRIPLE, RVGAS, STEAM, TFREEZE, ZVIR
from tidemark.operators.asof import constants

MISSING = -999.0


#: Fixed values in the next two functions: coefficients of the Goff-Gratch formulae.
def over_ice(t: np.ndarray) -> np.ndarray:
    r = ICE_TRIPLE / t
    return 10.0 ** (-9.09718 * (r - 1) - 3.56654 * np.log10(r) + 0.876793 * (1 - 1 / r) + np.log10(610.71))


def over_water(t: np.ndarray) -> np.ndarray:
    r = STEAM / t
    return 10.0 ** (
        -7.90298 * (r - 1) + 5.02808 * np.log10(r) - 1.3816e-7 * (10.0 ** (11.344 * (1 - 1 / r)) - 1)
        + 8.1328e-3 * (10.0 ** (-3.49149 * (r - 1)) - 1) + np.log10(101324.60)
    )


def blended(t: np.ndarray) -> np.ndarray:
    """Over ice below -20 C, over water above 0 C, between them linearly from one to the other."""
    share = np.clip((t - ICE_TRIPLE + 20) / 20, 0, 1)
    return (1 - share) * over_ice(np.minimum(t, ICE_TRIPLE)) + share * over_water(t)


def ice_or_water(t: np.ndarray) -> np.ndarray:
    return np.where(t < ICE_TRIPLE, over_ice(np.minimum(t, ICE_TRIPLE)), over_water(t))


FORMS = {"blend": blended, "liquid": over_water, "liquid_and_ice": ice_or_water}


@dataclass(frozen=True)
class Table:
    """Pressures, slopes and half curvatures at even temperatures of ``step`` from ``coldest`` to ``hottest`` Celsius."""

    form: str = "blend"
    step: float = 0.1
    coldest: float = COLDEST
    hottest: float = HOTTEST
    arrays: tuple = field(init=False, compare=False, repr=False)

    def __post_init__(self) -> None:
        n = round((self.hottest - self.coldest) / self.step) + 1
        t = self.coldest + TFREEZE + self.step * np.arange(n)
        if self.form == "simple":
            es = 610.78 * np.exp(-HLV / RVGAS * (1 / t - 1 / TFREEZE))
            slope = HLV * es / RVGAS / t**2
        else:
            f = FORMS[self.form]
            es, slope = f(t), (f(t + 0.1 * self.step) - f(t - 0.1 * self.step)) / (0.2 * self.step)
        # centred differences of the slopes, one-sided at the ends
        curve = np.gradient(slope, self.step) / 2
        object.__setattr__(self, "arrays", (es.tolist(), slope.tolist(), curve.tolist()))

    def lookup(self, t: Column) -> tuple[Column, Column, Column]:
        """Pressure, its slope and whether the temperature is within the table; null outside."""
        n = len(self.arrays[0])
        past = t - (self.coldest + TFREEZE)
        index = F.coalesce(((past + self.step / 2) / self.step).try_cast("int"), F.lit(-1))  # towards zero
        inside = (index >= 0) & (index < n)
        at = lambda k: F.element_at(constants(self.arrays[k]), F.when(inside, index + 1).otherwise(1))
        rest = past - self.step * index
        es = at(0) + rest * (at(1) + rest * at(2))
        return F.when(inside, es), F.when(inside, at(1) + 2 * rest * at(2)), inside


def saturated(
    df: DataFrame, group: list[str], t: str, p: str, table: Table, kind: str = "specific", humidity: str | None = None, hc: float = 1.0,
) -> DataFrame:
    """``df`` with ``saturated, slope, es, nbad``: humidity at the relative humidity ``hc``, its change with temperature.

    ``kind`` is ``specific`` or ``mixing``. With a column ``humidity`` of what the air holds the
    exact relation is used: its ratio to the vapour pressure is that of the air as it is.
    ``nbad`` counts the group's temperatures outside the table; where there is any, the
    other three are ``MISSING`` in the whole group. Null temperatures are null and not bad.
    Counts are aggregated by group and joined back, so that a large group is not one task's.
    """
    if kind not in ("specific", "mixing"):
        raise ValueError("kind is specific or mixing")
    es, slope, inside = table.lookup(F.col(t))
    rows = df.withColumns({"__es": es * hc, "__des": slope * hc, "__bad": F.when(F.col(t).isNotNull() & ~inside, 1).otherwise(0)})
    bad = rows.groupBy(*group).agg(F.sum("__bad").alias("nbad"))
    same = [rows[g].eqNullSafe(bad[g]) for g in group]
    met = same[0]
    for s in same[1:]:
        met = met & s
    rows = rows.join(bad.select(*group, "nbad"), met).drop(*[bad[g] for g in group])
    e, de, pressure = F.col("__es"), F.col("__des"), F.col(p)
    if humidity is not None:
        factor = (1 + ZVIR * F.col(humidity)) * EPS if kind == "specific" else EPS + F.col(humidity)
        value, change = factor * e / pressure, factor * de / pressure
    else:
        room = pressure - (1 - EPS) * e if kind == "specific" else pressure - e
        value = F.when(room > 0, EPS * e / room).otherwise(F.when(e.isNotNull(), EPS))
        change = EPS * pressure * de / (room * room)
    whole = lambda c: F.when(F.col("nbad") > 0, F.lit(MISSING)).otherwise(c)
    return rows.select(*df.columns, whole(value).alias("saturated"), whole(change).alias("slope"), whole(e).alias("es"), "nbad")
