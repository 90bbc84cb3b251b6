"""Saturation pressures from a table: the air of line items, one call an order's year and quarter."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, table
from tidemark.functions import vapour


def _form(t: str, kind: str) -> str:
    """The blended formula, or that over water, of an expression."""
    r, i = f"(373.16 / ({t}))", f"(273.16 / ({t}))"
    water = f"pow(10, -7.90298 * ({r} - 1) + 5.02808 * log10({r}) - 1.3816e-7 * (pow(10, 11.344 * (1 - 1 / {r})) - 1) + 8.1328e-3 * (pow(10, -3.49149 * ({r} - 1)) - 1) + log10(101324.60))"
    ice = f"pow(10, -9.09718 * ({i} - 1) - 3.56654 * log10({i}) + 0.876793 * (1 - 1 / {i}) + log10(610.71))"
    if kind == "liquid":
        return water
    return f"CASE WHEN {t} <= 253.16 THEN {ice} WHEN {t} >= 273.16 THEN {water} ELSE 0.05 * ((273.16 - ({t})) * {ice} + (({t}) - 253.16) * {water}) END"


def _table_sql(kind: str) -> str:
    slope = f"(({_form('t + 0.01', kind)}) - ({_form('t - 0.01', kind)})) / 0.02"
    return f"""n AS (SELECT i, 113.16 + 0.1 * i AS t FROM range(2601) r(i)), s AS (SELECT i, {_form('t', kind)} AS e, {slope} AS d FROM n),
tab AS (SELECT i, e, d, (coalesce(lead(d) OVER w, d) - coalesce(lag(d) OVER w, d)) / (0.1 * CASE WHEN i IN (0, 2600) THEN 1 ELSE 2 END) / 2 AS c FROM s WINDOW w AS (ORDER BY i))"""


_AIR_SQL = """a AS (SELECT l_orderkey, l_linenumber, l_suppkey % 20 AS g, CASE WHEN l_suppkey % 20 = 3 AND l_quantity > 45 THEN 400 WHEN l_suppkey % 20 = 4 AND l_quantity < 3 THEN 100 ELSE 150 + l_quantity * 4.003 END AS t,
  60000 + l_extendedprice AS p, l_discount / 10 AS q FROM lineitem),
k AS (SELECT *, trunc((t - 113.16 + 0.05) / 0.1)::BIGINT AS i FROM a),
l AS (SELECT k.* EXCLUDE (i), e + (t - 113.16 - 0.1 * tab.i) * (d + (t - 113.16 - 0.1 * tab.i) * c) AS es, d + 2 * (t - 113.16 - 0.1 * tab.i) * c AS de, sum(CASE WHEN tab.i IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY g) AS nbad FROM k LEFT JOIN tab ON tab.i = k.i)"""


def _air(spark, folder):
    group, x = F.col("l_suppkey") % 20, F.col("l_quantity")
    t = F.when((group == 3) & (x > 45), 400.0).when((group == 4) & (x < 3), 100.0).otherwise(150 + x * 4.003)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", group.alias("g"), t.alias("t"), (60000 + F.col("l_extendedprice")).alias("p"), (F.col("l_discount") / 10).alias("q"))


_EPS = "(287.04 / 461.50::DOUBLE)"


def _out(value: str, change: str) -> str:
    whole = lambda c, n: f"CASE WHEN nbad > 0 THEN -999 ELSE round({c}, {n}) END::DOUBLE"
    return f"SELECT l_orderkey, l_linenumber, nbad::BIGINT AS nbad, {whole('es', 4)} AS es, {whole(value, 7)} AS saturated, {whole(change, 7)} AS slope FROM l"


def _rounded(df):
    return df.select("l_orderkey", "l_linenumber", "nbad", F.round("es", 4).alias("es"), F.round("saturated", 7).alias("saturated"), F.round("slope", 7).alias("slope"))


@query(f"WITH {_table_sql('blend')}, {_AIR_SQL} " + _out(f"CASE WHEN p - (1 - {_EPS}) * es > 0 THEN {_EPS} * es / (p - (1 - {_EPS}) * es) ELSE {_EPS} END", f"{_EPS} * p * de / pow(p - (1 - {_EPS}) * es, 2)"))
def vapour_specific(spark, folder):
    """Groups with one temperature beyond the table have no value at all."""
    return _rounded(vapour.saturated(_air(spark, folder), ["g"], "t", "p", vapour.Table()))


@query(f"WITH {_table_sql('liquid')}, {_AIR_SQL} " + _out(f"(1 + (1 / {_EPS} - 1) * q) * {_EPS} * es * 0.9 / p", f"(1 + (1 / {_EPS} - 1) * q) * {_EPS} * de * 0.9 / p").replace("round(es, 4)", "round(es * 0.9, 4)"))
def vapour_exact(spark, folder):
    """Over liquid water at a relative humidity of 0.9, with the humidity that the air holds."""
    return _rounded(vapour.saturated(_air(spark, folder), ["g"], "t", "p", vapour.Table("liquid"), humidity="q", hc=0.9))


@query(f"WITH {_table_sql('blend')}, {_AIR_SQL} " + _out(f"CASE WHEN p - es > 0 THEN {_EPS} * es / (p - es) ELSE {_EPS} END", f"{_EPS} * p * de / pow(p - es, 2)"))
def vapour_mixing(spark, folder):
    return _rounded(vapour.saturated(_air(spark, folder), ["g"], "t", "p", vapour.Table(), kind="mixing"))
