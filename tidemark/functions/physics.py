"""Geophysical column functions. Temperatures in K, pressures in Pa, angles in radians."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Physical constants.
PI = math.pi
RADIUS = 6371.0e3
GRAV = 9.80
RDGAS = 287.04
RVGAS = 461.50
HLV = 2.500e6
TFREEZE = 273.16
KAPPA = 2.0 / 7.0
EPS = RDGAS / RVGAS
ZVIR = RVGAS / RDGAS - 1.0
ICE_TRIPLE = 273.16
STEAM = 373.16


#: Fixed values in the next two functions: coefficients of the Goff-Gratch formulae.
def es_ice(t: Column) -> Column:
    """Saturation pressure over ice (Goff-Gratch)."""
    r = F.lit(ICE_TRIPLE) / t
    e = -9.09718 * (r - 1) - 3.56654 * F.log10(r) + 0.876793 * (1 - 1 / r) + math.log10(610.71)
    return F.pow(F.lit(10.0), e)


def es_water(t: Column) -> Column:
    """Saturation pressure over water (Goff-Gratch)."""
    r = F.lit(STEAM) / t
    e = (
        -7.90298 * (r - 1) + 5.02808 * F.log10(r) - 1.3816e-7 * (F.pow(F.lit(10.0), 11.344 * (1 - 1 / r)) - 1)
        + 8.1328e-3 * (F.pow(F.lit(10.0), -3.49149 * (r - 1)) - 1) + math.log10(101324.60)
    )
    return F.pow(F.lit(10.0), e)


def es(t: Column) -> Column:
    """Over ice below -20 C, over water above 0 C, blended between."""
    blend = 0.05 * ((ICE_TRIPLE - t) * es_ice(t) + (t - ICE_TRIPLE + 20) * es_water(t))
    return F.when(t < ICE_TRIPLE - 20, es_ice(t)).when(t > ICE_TRIPLE, es_water(t)).otherwise(blend)


def es_simple(t: Column) -> Column:
    return 610.78 * F.exp(-HLV / RVGAS * (1 / t - 1 / TFREEZE))


def saturation_humidity(pressure: Column, e: Column) -> Column:
    """Specific humidity at saturation; EPS where the denominator is not positive."""
    d = pressure - (1 - EPS) * e
    return F.when(d > 0, EPS * e / d).otherwise(EPS)


def saturation_mixing_ratio(pressure: Column, e: Column) -> Column:
    d = pressure - e
    return F.when(d > 0, EPS * e / d).otherwise(EPS)


RICH_CRIT = 2.0
ZETA_TRANS = 0.5


def phi_m(zeta: Column, stable: int = 1) -> Column:
    b = 1 / RICH_CRIT
    unstable = F.pow(1 - 16 * F.least(zeta, F.lit(0.0)), -0.25)
    return F.when(zeta < 0, unstable).otherwise(_phi_stable(zeta, stable, b))


def phi_t(zeta: Column, stable: int = 1, cube_root: bool = False) -> Column:
    b = 1 / RICH_CRIT
    unstable = F.pow(1 - 16 * F.least(zeta, F.lit(0.0)), -1 / 3 if cube_root else -0.5)
    return F.when(zeta < 0, unstable).otherwise(_phi_stable(zeta, stable, b))


def _phi_stable(zeta: Column, stable: int, b: float) -> Column:
    if stable == 1:
        return 1 + zeta * (5 + b * zeta) / (1 + zeta)
    steep = 1 + (5 - b) * ZETA_TRANS
    return F.when(zeta < ZETA_TRANS, 1 + 5 * zeta).otherwise(steep + b * zeta)


def stable_mix(ri: Column, option: int = 1) -> Column:
    """Mixing of stable air at a Richardson number: 1 / phi^2, zero beyond the critical one."""
    b = 1 / RICH_CRIT
    if option == 1:
        # ri = zeta / phi(zeta) times 1 + zeta: (r - b) zeta^2 + (r - 6) zeta - 1 = 0 with r = 1 / ri
        r = 1 / ri
        a, c = r - b, -1.0
        q = r - 6
        zeta = (-q + F.sqrt(q * q - 4 * a * c)) / (2 * a)
        phi = 1 + zeta * (5 + b * zeta) / (1 + zeta)
        mixed = 1 / (phi * phi)
        return F.when((ri > 0) & (ri < RICH_CRIT), mixed).otherwise(0.0)
    steep = 1 + (5 - b) * ZETA_TRANS
    at = ZETA_TRANS / (1 + 5 * ZETA_TRANS)
    low, high = (1 - 5 * ri), (1 - b * ri) / steep
    return F.when((ri > 0) & (ri < at), low * low).when((ri >= at) & (ri < RICH_CRIT), high * high).otherwise(0.0)


ECCENTRICITY = 0.01671
OBLIQUITY = math.radians(23.439)
PERIHELION = math.radians(102.932)


def inverse_square_distance(angle: Column) -> Column:
    r = (1 - ECCENTRICITY**2) / (1 + ECCENTRICITY * F.cos(angle - PERIHELION))
    return 1 / (r * r)


def declination(angle: Column) -> Column:
    return F.asin(-math.sin(OBLIQUITY) * F.sin(angle))


def half_day(lat: Column, dec: Column) -> Column:
    c = -F.tan(lat) * F.tan(dec)
    return F.when(c >= 1, 0.0).when(c <= -1, PI).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def daily_mean_cosz(lat: Column, angle: Column) -> tuple[Column, Column]:
    """Mean cosine of the zenith angle over daylight, and the daylight fraction of the day."""
    dec = declination(angle)
    h = half_day(lat, dec)
    cosz = F.when(h == 0, 0.0).otherwise(F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.sin(h) / h)
    return F.greatest(cosz, F.lit(0.0)), h / PI


def orbit_table(steps: int = 3600) -> list[float]:
    """Orbital angle by equal times of year from the autumnal equinox (Runge-Kutta)."""
    dt = 2 * PI / steps
    norm = math.sqrt(1 - ECCENTRICITY**2)

    def rate(x: float) -> float:
        r = (1 - ECCENTRICITY**2) / (1 + ECCENTRICITY * math.cos(x - PERIHELION))
        return dt * norm / (r * r)

    out = [0.0]
    for _ in range(steps):
        x = out[-1]
        a = rate(x)
        b = rate(x + a / 2)
        c = rate(x + b / 2)
        d = rate(x + c)
        out.append(x + (a + 2 * b + 2 * c + d) / 6)
    return out


def gaussian_hill(lon: Column, lat: Column, height: float, lon0: float = PI / 2, lat0: float = PI / 4, wlon: float = PI / 12, wlat: float = PI / 12, rlon: float = 0.0, rlat: float = 0.0) -> Column:
    dx = F.abs(lon - lon0)
    dx = F.least(dx, F.abs(dx - 2 * PI))
    xx = F.greatest(F.lit(0.0), dx - rlon) / wlon
    yy = F.greatest(F.lit(0.0), F.abs(lat - lat0) - rlat) / wlat
    return height * F.exp(-xx * xx - yy * yy)


def zonal_temperature(lat: Column, year_part: Column, teq: float, tdif: float, tann: float, tlag: float) -> Column:
    """Sea surface temperature by latitude and time of year."""
    wave = F.sin(2 * PI * (year_part - tlag)) * tann
    return teq - tdif * F.sin(lat) * F.sin(lat) - wave * F.sin(lat)


def tracer_profile(surface: float, top: float, levels: int, level: Column, from_bottom: bool = False) -> Column:
    """A geometric profile from ``surface`` to ``top``: level 1 is the top of the column."""
    factor = (top / surface) ** (1 / (levels - 1))
    steps = (level - 1) if from_bottom else (F.lit(levels) - level)
    return F.lit(surface) * F.pow(F.lit(factor), steps)


def annual_mean_solar(df: DataFrame, lat: str, steps: int = 360) -> DataFrame:
    """``df`` with the year's mean of cosine times daylight times inverse square distance.

    The year is cut in ``steps`` equal times; the orbit is a literal of that many angles,
    folded within each row, so nothing is joined or shuffled.
    """
    orbit = orbit_table(steps)[:steps]
    angles = F.array(*[F.lit(a) for a in orbit])

    def add(total: Column, angle: Column) -> Column:
        cosz, light = daily_mean_cosz(F.col(lat), angle)
        return total + cosz * light * inverse_square_distance(angle)

    return df.withColumn("solar", F.aggregate(angles, F.lit(0.0), add) / steps)


#: Von Karman's constant, least drag, share of the critical number solved for.
VONKARM = 0.40
DRAG_MIN = 1.0e-5
SOLVED_SHARE = 0.95
ZETA_LIMIT = 1.0e-6


def _profile_m(zeta: Column, height: Column, rough: Column) -> Column:
    """Integral of phi_m / z from ``rough`` to ``height``."""
    zeta0 = zeta * rough / height
    x, x0 = (F.pow(1 - 16 * F.least(v, F.lit(0.0)), 0.25) for v in (zeta, zeta0))
    loss = F.log((1 + x * x) * (1 + x) * (1 + x) / ((1 + x0 * x0) * (1 + x0) * (1 + x0))) - 2 * (F.atan(x) - F.atan(x0))
    return F.log(height / rough) + F.when(zeta < 0, -loss).otherwise(_gain(zeta, zeta0))


def _profile_t(zeta: Column, height: Column, rough: Column) -> Column:
    """Integral of phi_t / z from ``rough`` to ``height``."""
    zeta0 = zeta * rough / height
    x, x0 = (F.sqrt(1 - 16 * F.least(v, F.lit(0.0))) for v in (zeta, zeta0))
    return F.log(height / rough) + F.when(zeta < 0, -2 * F.log((1 + x) / (1 + x0))).otherwise(_gain(zeta, zeta0))


def _gain(zeta: Column, zeta0: Column) -> Column:
    """What stable air adds to the logarithm: phi = 1 + zeta (5 + b zeta) / (1 + zeta)."""
    b = 1 / RICH_CRIT
    up, up0 = (F.greatest(v, F.lit(0.0)) for v in (zeta, zeta0))
    return (5 - b) * F.log((1 + up) / (1 + up0)) + b * (up - up0)


def _stability(rounds: int) -> Callable[..., Column]:
    """The ``zeta`` of bulk Richardson numbers over heights and roughnesses: ``_profile_m`` and ``_profile_t`` on arrays."""
    b = 1 / RICH_CRIT

    def number(zeta: np.ndarray, logs: tuple[np.ndarray, np.ndarray], parts: tuple[np.ndarray, np.ndarray], unstable: bool) -> np.ndarray:
        (log_m, log_t), (part_m, part_t) = logs, parts
        if not unstable:
            gain = lambda part: (5 - b) * np.log((1 + zeta) / (1 + zeta * part)) + b * (zeta - zeta * part)
            m, t = log_m + gain(part_m), log_t + gain(part_t)
            return zeta * t / (m * m)
        y, y0 = np.sqrt(1 - 16 * zeta), np.sqrt(1 - 16 * zeta * part_m)
        x, x0 = np.sqrt(y), np.sqrt(y0)
        m = log_m - np.log((1 + y) * (1 + x) * (1 + x) / ((1 + y0) * (1 + x0) * (1 + x0))) + 2 * (np.arctan(x) - np.arctan(x0))
        t = log_t - 2 * np.log((1 + y) / (1 + np.sqrt(1 - 16 * zeta * part_t)))
        return zeta * t / (m * m)

    def solved(rich: np.ndarray, height: np.ndarray, z0: np.ndarray, zt: np.ndarray, unstable: bool) -> np.ndarray:
        # brackets in zeta: what solves for SOLVED_SHARE of the critical number is far inside
        low, high = (np.full(len(rich), x) for x in ((-1.0e5, 0.0) if unstable else (0.0, 1.0e5)))
        parts = z0 / height, zt / height
        logs = tuple(np.log(height / rough) for rough in (z0, zt))
        for _ in range(rounds):
            middle = (low + high) / 2
            up = number(middle, logs, parts, unstable) < rich
            low, high = np.where(up, middle, low), np.where(up, high, middle)
        return (low + high) / 2

    @F.pandas_udf("double")
    def stability(rich: pd.Series, height: pd.Series, z0: pd.Series, zt: pd.Series) -> pd.Series:
        rows = pd.DataFrame({"rich": rich, "height": height, "z0": z0, "zt": zt}).astype(float)
        group = rows.groupby(list(rows), sort=False, dropna=False)
        place = group.ngroup().to_numpy()
        different = np.empty((place.max(initial=-1) + 1, 4))
        different[place] = rows.to_numpy()
        out = np.full(len(different), np.nan)
        with np.errstate(all="ignore"):
            for unstable in (True, False):
                at = different[:, 0] < 0 if unstable else (different[:, 0] >= 0) & (different[:, 0] < SOLVED_SHARE * RICH_CRIT)
                out[at] = solved(*different[at].T, unstable)
        return pd.Series(out[place])

    return stability


def surface_drag(df: DataFrame, rounds: int = 60, neutral: bool = False) -> DataFrame:
    """``df(pt, pt0, z, z0, zt, speed)`` with ``drag_m, drag_t, u_star, b_star`` and ``zeta``.

    The stability ``zeta`` of the bulk Richardson number is found by halving a bracket
    ``rounds`` times (the number grows with ``zeta``), for the different rows of an Arrow
    batch at once. Beyond 0.95 of the critical number the least
    drag holds and ``zeta`` is null. A row with a null input gets nulls. With a column
    ``zq`` there is ``drag_q`` too. ``neutral`` takes ``zeta`` as zero everywhere.
    """
    rough = ["z0", "zt", *(["zq"] if "zq" in df.columns else [])]
    buoyancy = GRAV * (F.col("pt0") - F.col("pt")) / F.col("pt0")
    height = F.greatest("z", *rough)
    rich = -F.col("z") * buoyancy / (F.col("speed") * F.col("speed") + 1.0e-4)
    known = reduce(and_, [F.col(c).isNotNull() for c in rough])
    rich = F.when(known, rich * 0.0 if neutral else rich)
    df = df.withColumn("__b", buoyancy).withColumn("__h", height).withColumn("__ri", rich)
    h, z0, zt, ri = F.col("__h"), F.col("z0"), F.col("zt"), F.col("__ri")

    zeta = F.when(ri < SOLVED_SHARE * RICH_CRIT, F.lit(0.0) if neutral else _stability(rounds)(ri, h, z0, zt))
    df = df.withColumn("zeta", F.when(F.abs(zeta) < ZETA_LIMIT, 0.0).otherwise(zeta))
    least = F.lit(math.sqrt(DRAG_MIN))
    beyond = ri >= SOLVED_SHARE * RICH_CRIT
    us = F.when(beyond, least).when(ri.isNotNull(), F.greatest(VONKARM / _profile_m(F.col("zeta"), h, z0), least))
    bs = F.when(beyond, least).when(ri.isNotNull(), F.greatest(VONKARM / _profile_t(F.col("zeta"), h, zt), least))
    if "zq" in rough:
        qs = F.when(beyond, least).when(ri.isNotNull(), F.greatest(VONKARM / _profile_t(F.col("zeta"), h, F.col("zq")), least))
        df = df.withColumn("drag_q", us * qs)
    df = df.withColumn("__us", us).withColumn("__bs", bs)
    out = df.withColumn("drag_m", F.col("__us") * F.col("__us")).withColumn("drag_t", F.col("__us") * F.col("__bs"))
    out = out.withColumn("u_star", F.col("__us") * F.col("speed")).withColumn("b_star", F.col("__bs") * F.col("__b"))
    return out.drop("__b", "__h", "__ri", "__us", "__bs")


def wind_and_scalar_shares(z: Column, ref: Column, ref_t: Column, z0: Column, zt: Column, u_star: Column, b_star: Column, neutral: bool = False) -> tuple[Column, Column]:
    """Shares of the surface-to-``z`` difference of wind and of scalars reached at ``ref`` and ``ref_t``.

    ``neutral``, and still air (``u_star`` not positive), use logarithms alone.
    """
    zeta = F.lit(0.0) if neutral else F.when(u_star > 0, -VONKARM * b_star * z / (u_star * u_star)).otherwise(0.0)
    m = 1 - _profile_m(zeta, z, ref) / _profile_m(zeta, z, z0)
    return m, 1 - _profile_t(zeta, z, ref_t) / _profile_t(zeta, z, zt)


#: Fixed value: the least friction velocity.
USTAR_MIN = 1.0e-10


def diffusivity(z: Column, u_star: Column, b_star: Column, neutral: bool = False, stable: int = 1) -> tuple[Column, Column]:
    """Diffusivities of momentum and heat at height ``z`` in the surface layer."""
    u = F.greatest(u_star, F.lit(USTAR_MIN))
    plain = VONKARM * u * z
    if neutral:
        return plain, plain
    zeta = -VONKARM * b_star * z / (u * u)
    return plain / phi_m(zeta, stable), plain / phi_t(zeta, stable)


def diurnal_solar(lat: Column, lon: Column, gmt: Column, angle: Column, dt: Column | None = None, allow_negative: bool = False) -> tuple[Column, Column]:
    """Cosine of the zenith angle and daylight fraction, at a time of day or over ``dt`` after it.

    Times of day are angles (midnight at longitude 0 is zero, a day 2 pi); ``dt`` is at
    most a day. Over ``dt`` the cosine is the mean over the lit part, found as the overlap
    with this day's and the next day's light; with ``allow_negative`` it is the mean over
    all of ``dt``.
    """
    dec = declination(angle)
    a, b, h = F.sin(lat) * F.sin(dec), F.cos(lat) * F.cos(dec), half_day(lat, dec)
    t = F.pmod(gmt + lon, F.lit(2 * PI)) - PI
    if dt is None:
        lit, cosz = F.abs(t) < h, a + b * F.cos(t)
        light = F.when(lit, 1.0).otherwise(0.0)
        return (cosz if allow_negative else F.when(lit, F.greatest(cosz, F.lit(0.0))).otherwise(0.0)), light
    length, area = F.lit(0.0), F.lit(0.0)
    for noon in (0.0, 2 * PI):
        start = F.greatest(t, noon - h)
        end = F.greatest(F.least(t + dt, noon + h), start)
        length, area = length + (end - start), area + a * (end - start) + b * (F.sin(end) - F.sin(start))
    if allow_negative:
        return a + b * (F.sin(t + dt) - F.sin(t)) / dt, length / dt
    return F.when(length > 0, F.greatest(area / length, F.lit(0.0))).otherwise(0.0), length / dt


def es_slope(t: Column, form=es, step: float = 0.01) -> Column:
    """Change of a saturation pressure with temperature, as a centred difference."""
    return (form(t + step) - form(t - step)) / (2 * step)


#: The temperatures in Celsius that saturation pressures are meant for.
COLDEST, HOTTEST = -160.0, 100.0


def temperature_report(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Per key the number of temperatures outside the range of saturation pressures, the least and the most.

    NaN is outside; null is counted nowhere.
    """
    bad = ~F.col(t).between(COLDEST + TFREEZE, HOTTEST + TFREEZE) | F.isnan(t)
    return df.groupBy(*keys).agg(F.count_if(bad).alias("bad"), F.min(t).alias("low"), F.max(t).alias("high"))


#: Fixed value: water is not colder.
ICE_CRITICAL = 271.38


def clip_surface(value: Column, kind: str) -> Column:
    """Ice shares within 0 and 1; water temperatures not under freezing. Null stays null."""
    if kind == "ice":
        return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
    if kind == "sst":
        return F.when(value.isNotNull(), F.greatest(value, F.lit(ICE_CRITICAL)))
    raise ValueError("kind is ice or sst")
