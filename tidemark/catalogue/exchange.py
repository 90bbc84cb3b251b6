"""Exchange between grids: nations are side 1, regions side 2, customers the overlaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, table
from tidemark.operators import exchange as xg

SEGMENTS = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 ELSE 4 END"
CELLS = f"""WITH cells AS (SELECT c_custkey AS cell, c_nationkey AS side1, n_regionkey AS side2, {SEGMENTS} AS k, (1 + c_custkey % 7)::DOUBLE AS area,
 (c_custkey % 3 - 1) * 0.5 AS di, (c_custkey % 5 - 2) * 0.25 AS dj FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def cells(spark, folder):
    c = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("side1"), F.col("n_regionkey").alias("side2"), F.expr(SEGMENTS).alias("k"),
        (1 + F.col("c_custkey") % 7).cast("double").alias("area"), ((F.col("c_custkey") % 3 - 1) * 0.5).alias("di"), ((F.col("c_custkey") % 5 - 2) * 0.25).alias("dj"),
    )


def first(spark, folder):
    n = F.col("n_nationkey")
    return table(spark, folder, "nation").select(n.alias("side1"), (n * 3 + 1).cast("double").alias("v"), (n % 4).cast("double").alias("dx"), (n % 6).cast("double").alias("dy"))


@query(CELLS + " SELECT cell, (side1 * 3 + 1)::DOUBLE AS x FROM cells")
def xgrid_put1(spark, folder):
    return xg.put_first(cells(spark, folder), first(spark, folder), "v").select("cell", "x")


@query(CELLS + " SELECT cell, (side1 * 3 + 1 + dj * (side1 % 6) + di * (side1 % 4))::DOUBLE AS x FROM cells")
def xgrid_put1_order2(spark, folder):
    return xg.put_first(cells(spark, folder), first(spark, folder), "v", gradient=True).select("cell", "x")


def second(spark, folder):
    k = F.explode(F.sequence(F.lit(1), F.lit(4)))
    r = table(spark, folder, "region").select(F.col("r_regionkey").alias("side2"), k.alias("k"))
    return r.withColumn("v", (F.col("side2") * 10 + F.col("k")).cast("double"))


@query(CELLS + " SELECT cell, (side2 * 10 + k)::DOUBLE AS x FROM cells")
def xgrid_put2(spark, folder):
    return xg.put_second(cells(spark, folder), second(spark, folder), "v").select("cell", "x")


@query(CELLS + ", a AS (SELECT side1, sum(area) AS ca FROM cells GROUP BY side1) SELECT side1, round(sum(area * (side2 * 10 + k)) / max(ca), 8) AS value FROM cells JOIN a USING (side1) GROUP BY side1")
def xgrid_get1(spark, folder):
    c = cells(spark, folder)
    put = xg.put_second(c, second(spark, folder), "v")
    sides = c.groupBy("side1").agg(F.sum("area").alias("cell_area"))
    return xg.get_side(put, sides, ["side1"]).select("side1", F.round("value", 8).alias("value"))


@query(CELLS + ", a AS (SELECT side2, sum(area) AS ca FROM cells GROUP BY side2) SELECT side2, k, round(sum(area * (side1 * 3 + 1)) / max(ca), 8) AS value FROM cells JOIN a USING (side2) GROUP BY side2, k")
def xgrid_get2(spark, folder):
    c = cells(spark, folder)
    put = xg.put_first(c, first(spark, folder), "v")
    whole = c.groupBy("side2").agg(F.sum("area").alias("cell_area"))
    sides = c.select("side2", "k").distinct().join(whole, "side2")
    return xg.get_side(put, sides, ["side2", "k"]).select("side2", "k", F.round("value", 8).alias("value"))


@query(CELLS + """, t AS (SELECT sum(area * (side1 * 3 + 1)) AS total FROM cells) SELECT round(total, 4) AS direct, round(total, 4) AS on_second, round(total, 4) AS round_trip FROM t""")
def xgrid_conservation(spark, folder):
    c = cells(spark, folder)
    one = c.groupBy("side1").agg(F.sum("area").alias("cell_area")).join(first(spark, folder), "side1")
    two = c.groupBy("side2", "k").agg(F.sum("area").alias("cell_area"))
    out = xg.conservation(c, one, two, "v")
    return out.select(*[F.round(x, 4).alias(x) for x in ("direct", "on_second", "round_trip")])


@query("""
SELECT account, sum(amount)::DOUBLE AS balance FROM (SELECT o_orderstatus AS account, -(o_totalprice::DECIMAL(18,2)) AS amount FROM orders
UNION ALL SELECT o_orderpriority, o_totalprice::DECIMAL(18,2) FROM orders) GROUP BY account""")
def stock_move(spark, folder):
    df = table(spark, folder, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    return xg.ledger(df, "o_orderstatus", "o_orderpriority", "amount").select("account", F.col("balance").cast("double").alias("balance"))


@query("SELECT l_returnflag, round(sum(l_tax * l_discount * l_quantity) * (1800.0::DOUBLE * 4 * pi() * 2.0 * 2.0), 2) AS stock FROM lineitem GROUP BY ALL")
def stock_integral(spark, folder):
    out = xg.stock(table(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity", "l_tax", "l_discount", 1800.0, 2.0)
    return out.select("l_returnflag", F.round("stock", 2).alias("stock"))
