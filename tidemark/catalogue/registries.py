"""Registries: brands are tracers of models by type of part, suppliers' nations are conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, table
from tidemark.operators import registry as reg
from tidemark.operators.fields import Override
from tidemark.operators.gas_flux import Flux, fluxes, register

TRACERS = """WITH f AS (SELECT p_type AS model, p_brand AS tracer, min(p_partkey) AS place, max_by(p_name, p_partkey) FILTER (p_partkey % 3 = 0) AS longname,
 max_by('kg ' || p_size, p_partkey) FILTER (p_partkey % 3 = 1) AS units, max_by(CASE WHEN p_size > 25 THEN 'Diagnostic' ELSE 'prognostic' END, p_partkey) FILTER (p_partkey % 3 = 2) AS kind
 FROM part GROUP BY ALL),
t AS (SELECT model, tracer, row_number() OVER (PARTITION BY model ORDER BY place, tracer) AS number, coalesce(longname, tracer) AS longname, coalesce(units, 'none') AS units,
 coalesce(kind, '') <> 'Diagnostic' AS prognostic FROM f)"""
CELLS = """WITH c AS (SELECT s_suppkey AS i, s_nationkey AS j, 1::BIGINT AS k, s_nationkey % 5 AS bc, 1 AS field, s_acctbal AS value FROM supplier),
m AS (SELECT bc, CASE bc % 3 WHEN 0 THEN 'air_sea_gas_flux' WHEN 1 THEN 'land_sea_runoff' END AS flux_type, bc < 3 AS pass_through_ice FROM range(5) r(bc))"""


def values(spark, folder):
    name = F.when(F.col("p_partkey") % 3 == 0, "longname").when(F.col("p_partkey") % 3 == 1, "units").otherwise("tracer_type")
    kind = F.when(F.col("p_size") > 25, "Diagnostic").otherwise("prognostic")
    value = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("kg "), F.col("p_size"))).otherwise(kind)
    return table(spark, folder, "part").select(F.col("p_partkey").alias("place"), F.col("p_type").alias("model"), F.col("p_brand").alias("tracer"), name.alias("parameter"), value.alias("value"))


@query(TRACERS + " SELECT * FROM t")
def tracer_table(spark, folder):
    return reg.tracer_table(values(spark, folder))


@query(TRACERS + " SELECT model, count(*) AS total, count(*) FILTER (prognostic) AS prognostic, count(*) FILTER (NOT prognostic) AS diagnostic FROM t GROUP BY model")
def tracer_counts(spark, folder):
    return reg.tracer_counts(reg.tracer_table(values(spark, folder)))


@query(TRACERS + """ SELECT p_partkey, p_type AS model, p_brand AS tracer, number FROM part LEFT JOIN t ON model = p_type AND tracer = p_brand AND prognostic""")
def tracer_index(spark, folder):
    known = reg.tracer_table(values(spark, folder)).where("prognostic")
    wanted = table(spark, folder, "part").select("p_partkey", F.col("p_type").alias("model"), F.col("p_brand").alias("tracer"))
    return reg.index_of(known, wanted, "model", "tracer").select("p_partkey", "model", "tracer", "number")


def fields(spark, folder):
    s = table(spark, folder, "supplier")
    return s.select(
        (F.col("s_nationkey") % 5).alias("bc"), F.lit(1).alias("field"), F.col("s_suppkey").alias("i"), F.col("s_nationkey").alias("j"),
        F.lit(1).cast("long").alias("k"), F.col("s_acctbal").alias("value"),
    )


def conditions(spark):
    kind = F.when(F.col("id") % 3 == 0, "air_sea_gas_flux  ").when(F.col("id") % 3 == 1, "land_sea_runoff")
    return spark.range(5).select(F.col("id").alias("bc"), kind.alias("flux_type"), (F.col("id") < 3).alias("pass_through_ice"))


@query(CELLS + " SELECT c.bc, field, i, j, k, value FROM c JOIN m USING (bc) WHERE flux_type IS DISTINCT FROM 'air_sea_gas_flux' AND pass_through_ice")
def flux_selection(spark, folder):
    return reg.select_fields(fields(spark, folder), conditions(spark), exclude="air_sea_gas_flux", pass_through_ice=True).select("bc", "field", "i", "j", "k", "value")


@query(CELLS + " SELECT i, j, k, value * 2 AS value FROM c WHERE bc = 2")
def flux_extract(spark, folder):
    return reg.extract(fields(spark, folder), 2, 1, scale=2.0)


@query(CELLS + " SELECT bc, i, j, CASE WHEN bc = 2 AND i % 2 = 0 THEN i * 0.5::DOUBLE ELSE value END AS value FROM c")
def flux_set(spark, folder):
    held = fields(spark, folder)
    data = held.where("i % 2 = 0").select("i", "j", F.col("i").cast("double").alias("value"))
    return reg.set_field(held, data, 2, 1, scale=0.5).select("bc", "i", "j", "value")


@query(CELLS + ", n AS (SELECT bc, unnest(range(1, bc + 2)) AS field FROM range(5) r(bc)) SELECT n.bc, n.field, i, j, k, 1.5::DOUBLE AS value FROM c, n")
def flux_spawn(spark, folder):
    meta = spark.range(5).select(F.col("id").alias("bc"), (F.col("id") + 1).alias("n_fields"))
    return reg.spawn(meta, fields(spark, folder).select("i", "j", "k"), 1.5)


FLUXES = [
    Flux("co2", "air_sea_gas_flux", "ocmip2", (9.36e-07, 9.8692e-06)),
    Flux("o2", "air_sea_gas_flux", "linear", (2.0e-07, 3.0, 9.8692e-06)),
    Flux("cfc", "air_sea_gas_flux_generic", "ocmip2", (6.97e-07, 9.8692e-06)),
    Flux("iron", "air_sea_deposition", "dry", (55.847,)),
    Flux("silt", "land_sea_runoff", "river", (1.0,)),
]
CHANGES = [{"name": "o2", "parameters": {2: 5.0}}, {"name": "silt", "parameters": [2.5, 9.0], "factor": 1000.0}, {"name": "iron", "implementation": "wet"}]


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity / 3 AS u, 1.0e5 + l_extendedprice / 10 AS ps, 3.0e-4 + l_discount / 1000 AS pc, 30 + l_tax * 100 AS al, 0.01 * (1 + l_linenumber) AS cs, 500 + l_quantity AS sc, l_extendedprice AS x FROM lineitem),
f AS (SELECT *, 6.97e-07 * u * u * sqrt(660 / sc) AS kw, al * pc * ps * 9.8692e-06 AS b FROM c)
SELECT l_orderkey, l_linenumber, 'co2' AS name, round(1e9 * 9.36e-07 * u * u * (cs - b), 4) AS flux, NULL::DOUBLE AS kw, NULL::DOUBLE AS flux0, NULL::DOUBLE AS deltap FROM f
UNION ALL SELECT l_orderkey, l_linenumber, 'o2', round(1e9 * 2.0e-07 * greatest(0, u - 5) * (cs - b), 4), NULL, NULL, NULL FROM f
UNION ALL SELECT l_orderkey, l_linenumber, 'cfc', round(1e9 * kw * (cs - b), 4), round(1e9 * kw, 4), round(1e9 * kw * cs, 4), round((cs - b) / (al * 9.8692e-06), 4) FROM f
UNION ALL SELECT l_orderkey, l_linenumber, 'iron', round(x / 55.847, 4), NULL, NULL, NULL FROM f
UNION ALL SELECT l_orderkey, l_linenumber, 'silt', round(1000 * x / 2.5, 2), NULL, NULL, NULL FROM f""")
def gas_fluxes(spark, folder):
    """Five fluxes with defaults and changes, in one pass over the cells."""
    q = F.col("l_quantity")
    cells = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", (q / 3).alias("u10"), (1.0e5 + F.col("l_extendedprice") / 10).alias("psurf"), (3.0e-4 + F.col("l_discount") / 1000).alias("pcair"),
        (30 + F.col("l_tax") * 100).alias("alpha"), (0.01 * (1 + F.col("l_linenumber"))).alias("csurf"), (500 + q).alias("sc_no"), F.col("l_extendedprice").alias("mass"),
    )
    out = fluxes(cells, register(FLUXES, CHANGES), ["l_orderkey", "l_linenumber"], {"iron": {"deposition": "mass"}, "silt": {"runoff": "mass"}})
    digits = F.when(F.col("name") == "iron", F.round("flux", 4)).when(F.col("name") == "silt", F.round("flux", 2)).otherwise(F.round(F.col("flux") * 1e9, 4))
    scaled = lambda c: F.round(F.col(c) * 1e9, 4).alias(c)
    return out.select("l_orderkey", "l_linenumber", "name", digits.alias("flux"), scaled("kw"), scaled("flux0"), F.round("deltap", 4).alias("deltap"))


@query(CELLS + """, n AS (SELECT bc, CASE bc WHEN 0 THEN 'co2' WHEN 1 THEN 'o2' WHEN 2 THEN 'cfc' WHEN 3 THEN 'iron' END AS name FROM range(5) r(bc)), f AS (SELECT * FROM c JOIN n USING (bc))
SELECT bc, i, j, CASE name WHEN 'co2' THEN 7.5 WHEN 'o2' THEN CASE WHEN i % 3 <> 0 THEN i * 2.0 END WHEN 'cfc' THEN CASE WHEN i BETWEEN 20 AND 60 AND j BETWEEN 5 AND 20 AND i % 3 <> 0 THEN i * 3.0 ELSE value END ELSE value END::DOUBLE AS value FROM f""")
def override_conditions(spark, folder):
    """Fields of conditions replaced by a constant, by a file, and by a file in a region; the others stay."""
    table_rows = [Override("OCN", "co2", None, 7.5), Override("OCN", "o2", "o2_file", 2.0), Override("ATM", "iron", None, 1.0), Override("OCN", "cfc", "cfc_file", 3.0, (20.0, 60.0, 5.0, 20.0)), Override("OCN", "co2", None, 9.0)]
    held = fields(spark, folder).withColumns({"lon": F.col("i").cast("double"), "lat": F.col("j").cast("double")})
    names = spark.createDataFrame([(0, 1, "co2"), (1, 1, "o2"), (2, 1, "cfc"), (3, 1, "iron")], "bc long, field int, name string")
    files = held.where("i % 3 <> 0").select(F.explode(F.array(F.lit("o2"), F.lit("cfc"))).alias("name"), "i", "j", F.col("i").cast("double").alias("value"))
    return reg.override_conditions(held, names, table_rows, "OCN", files).select("bc", "i", "j", "value")
