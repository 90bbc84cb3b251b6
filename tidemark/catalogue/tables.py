"""Value trees, reports in text, mask tables, names and days of the month: parts and suppliers are what is set and asked."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, table
from tidemark.functions import strings as st
from tidemark.functions.tables import scratch_folder
from tidemark.operators import asof, reports, tree
from tidemark.sources import ascii

VALUES = """WITH v AS (SELECT '/models/' || replace(p_type, ' ', '_') || '/' || p_brand || '/size' AS path, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) - 1 AS index, p_size::VARCHAR AS value FROM part)"""


def _tree(spark, folder):
    from pyspark.sql import Window

    path = F.concat(F.lit("/models/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("/"), F.col("p_brand"), F.lit("/size"))
    index = (F.row_number().over(Window.partitionBy("p_type", "p_brand").orderBy("p_partkey")) - 1).alias("index")
    return table(spark, folder, "part").select(path.alias("path"), index, F.col("p_size").cast("string").alias("value"), F.lit("int").alias("type"))


@query(VALUES + """ SELECT p_partkey, coalesce(v.value, '-1') AS value FROM part p LEFT JOIN v ON v.path = '/models/' || replace(p_type, ' ', '_') || '/' || p_brand || '/size' AND v.index = p_partkey % 3""")
def tree_values(spark, folder):
    """The second or third of a list of values, or a default."""
    path = F.concat(F.lit("models//"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("/"), F.col("p_brand"), F.lit("/size/"))
    wanted = table(spark, folder, "part").select("p_partkey", path.alias("path"), (F.col("p_partkey") % 3).cast("int").alias("index"), F.lit("-1").alias("default"))
    return tree.get(_tree(spark, folder), wanted, "int").select("p_partkey", "value")


@query(VALUES + """, c AS (SELECT DISTINCT regexp_replace(path, '/[^/]*/size$', '') AS path, regexp_extract(path, '/([^/]*)/size$', 1) AS name FROM v) SELECT path, name FROM c""")
def tree_children(spark, folder):
    t = _tree(spark, folder)
    return tree.children(t, t.select(F.regexp_replace("path", "/[^/]*/size$", "").alias("path")).distinct())


@query(VALUES + """ SELECT replace(path, '/models/', '/old/') AS path, index, value FROM v UNION ALL SELECT '/models/new/' || regexp_extract(path, '/([^/]*/size)$', 1), index, value FROM v
WHERE path LIKE (SELECT min(regexp_replace(path, '/[^/]*/size$', '')) FROM v) || '/%'""")
def tree_copy(spark, folder):
    """The whole tree renamed, after the first model was copied to a new place."""
    t = _tree(spark, folder)
    first = t.agg(F.min(F.regexp_replace("path", "/[^/]*/size$", ""))).first()[0]
    t = tree.copy(t, spark.createDataFrame([("/models", "/old")], "old string, new string"), move=True)
    pairs = spark.createDataFrame([(first.replace("/models", "/old"), "models/new/")], "old string, new string")
    return tree.copy(t, pairs).select("path", F.col("index").cast("long").alias("index"), "value")


@query("""
WITH c AS (SELECT s_suppkey AS k, s_nationkey AS j, (s_suppkey % 36) * 10.0 AS x, s_suppkey // 36 % 18 * 10.0 - 90 AS y, s_acctbal AS v FROM supplier)
SELECT 'sea' AS name, k, v FROM c WHERE x = 350 AND y = -90 UNION ALL SELECT 'land', k, v FROM c WHERE x = 20 AND y = -80 UNION ALL SELECT 'ij', k, v FROM c WHERE k = 7""")
def diagnostic_columns(spark, folder):
    """Cells of ten degrees that two points lie in, and one by its number."""
    k = F.col("s_suppkey")
    x, y = (k % 36) * 10.0 - 360, F.floor(k / 36) % 18 * 10.0 - 90
    cells = table(spark, folder, "supplier").select(k.alias("i"), F.lit(1).alias("j"), x.alias("lon0"), (x + 10).alias("lon1"), y.alias("lat0"), (y + 10).alias("lat1"), F.col("s_acctbal").alias("v"))
    out = reports.diagnostic_columns(cells, [("sea", 355.0, -85.0), ("land", 20.0, -80.0)], [("ij", 7, 1)])
    return out.select("name", F.col("i").alias("k"), "v")


@query("""
WITH m AS (SELECT l_linenumber AS t, sum(l_quantity::DECIMAL(18,2) * l_tax::DECIMAL(18,2))::DOUBLE / sum(l_tax::DECIMAL(18,2))::DOUBLE AS q, sum(l_discount::DECIMAL(18,2) * l_tax::DECIMAL(18,2))::DOUBLE / sum(l_tax::DECIMAL(18,2))::DOUBLE AS d FROM lineitem GROUP BY ALL)
SELECT t, printf('%11.3f', t::DOUBLE) || printf('%12.5f', q) || printf('%10.6f', d) AS line FROM m""")
def average_log(spark, folder):
    """Area means of two fields, a line of text a step."""
    lines = table(spark, folder, "lineitem")
    exact = lambda c: F.col(c).cast("decimal(18,2)")
    both = F.explode(F.array(F.struct(F.lit("quantity").alias("field"), exact("l_quantity").alias("value")), F.struct(F.lit("discount").alias("field"), exact("l_discount").alias("value"))))
    rows = lines.select(F.col("l_linenumber").alias("t"), exact("l_tax").alias("area"), both.alias("x")).select("t", "area", "x.*")
    sums = rows.groupBy("t", "field").agg(F.sum(F.col("value") * F.col("area")).cast("double").alias("s"), F.sum("area").cast("double").alias("area"))
    out = reports.average_lines(sums.withColumn("value", F.col("s") / F.col("area")), "t", [("quantity", "%12.5f"), ("discount", "%10.6f")])
    return out.select("t", "line")


@query("""
WITH r AS (SELECT p_type, p_brand, min(p_partkey) AS place FROM part GROUP BY ALL),
s AS (SELECT p_type, p_brand, string_agg('  - var: ''#' || p_partkey || '''' || chr(10) || '    size: ' || p_size, chr(10) ORDER BY p_partkey) AS subs FROM part WHERE p_partkey % 5 = 0 GROUP BY ALL),
i AS (SELECT p_type, string_agg('- file: ''''''' || p_brand || '''' || coalesce(chr(10) || '  varlist:' || chr(10) || subs, ''), chr(10) ORDER BY place) AS items FROM r LEFT JOIN s USING (p_type, p_brand) GROUP BY p_type)
SELECT p_type, 'title: parts' || chr(10) || 'files:' || chr(10) || items || chr(10) AS text FROM i""")
def yaml_plan(spark, folder):
    """A file a brand and a variable every fifth part, as one YAML text a type."""
    part = table(spark, folder, "part")
    item, doc = F.col("p_brand").alias("item"), F.col("p_type").alias("document")
    own = part.groupBy(doc, item).agg(F.min("p_partkey").alias("place"))
    quoted = F.concat(F.lit("'"), F.col("item"))  # a text that YAML would read as quoted
    own = own.select("document", "place", "item", F.lit("file").alias("key"), quoted.alias("value"), F.lit(None).cast("string").alias("sub"))
    fifth = part.where("p_partkey % 5 = 0")
    sub = F.col("p_partkey").cast("string").alias("sub")
    var = fifth.select(doc, (F.col("p_partkey") * 2).alias("place"), item, F.lit("var").alias("key"), F.concat(F.lit("#"), F.col("p_partkey")).alias("value"), sub)
    size = fifth.select(doc, (F.col("p_partkey") * 2 + 1).alias("place"), item, F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value"), sub)
    return reports.yaml_text(own.unionByName(var).unionByName(size), "p_type", "files", "varlist", {"title": "parts"})


@query("SELECT DISTINCT l_suppkey % 10 + 1 AS i, l_linenumber AS j FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 10 = l_suppkey % 10 AND s_suppkey % 7 + 1 = l_linenumber AND s_acctbal < 2000)")
def mask_table_file(spark, folder):
    """Blocks that a mask table in text names are left out."""
    masked = table(spark, folder, "supplier").where("s_acctbal < 2000").select((F.col("s_suppkey") % 10 + 1).alias("i"), (F.col("s_suppkey") % 7 + 1).alias("j")).distinct()
    rows = masked.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(", ", "i", "j"))), "\n").alias("text"))
    path = f"{scratch_folder(spark)}/tidemark-mask-{uuid.uuid4().hex}"
    rows.select(F.concat(F.col("n").cast("string"), F.lit("\n# layout\n10, 7\n"), "text").alias("value")).coalesce(1).write.text(path)
    blocks = table(spark, folder, "lineitem").select((F.col("l_suppkey") % 10 + 1).alias("i"), F.col("l_linenumber").alias("j")).distinct()
    return blocks.join(ascii.mask_table(spark, path)[0], ["i", "j"], "left_anti")


@query("""
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS names, string_split(p_type, ' ') AS more, p_retailprice AS x FROM part)
SELECT p_partkey, coalesce(list_position(names, names[2]), 0)::INT AS place, coalesce(list_position(names, 'nothing'), 0)::INT AS none, len(list_distinct(names))::INT AS n, printf('%010.3f', x) AS x,
 array_to_string(list_transform([p_partkey, p_partkey + 1], lambda v: printf('%05d', v)), ', ') AS both, len(list_distinct(list_concat(names, more)))::INT AS together FROM w""")
def name_lists(spark, folder):
    names, more = F.split("p_name", " "), F.split("p_type", " ")
    both = st.list_text(F.array("p_partkey", F.col("p_partkey") + 1), "%05d")
    return table(spark, folder, "part").select(
        "p_partkey", st.name_index(names, F.concat(F.get(names, F.lit(1)), F.lit("  "))).alias("place"), st.name_index(names, F.lit("nothing")).alias("none"), st.count_unique(names).alias("n"),
        st.number_text(F.col("p_retailprice"), "%010.3f").alias("x"), both.alias("both"), F.size(st.append_unique(names, more)).alias("together"),
    )


@query("""
WITH e AS (SELECT event_id, (epoch_us(ts) - epoch_us(date_trunc('month', ts))) / 86400000000.0::DOUBLE AS d, day(last_day(ts))::DOUBLE AS n FROM events)
SELECT event_id, round(CASE WHEN d < 2 THEN 40 + (d + n - 25) / (n - 23) * (10 - 40) WHEN d < 12 THEN 10 + (d - 2) / 10 * 15 WHEN d < 25 THEN 25 + (d - 12) / 13 * 15 ELSE 40 + (d - 25) / (n - 23) * (10 - 40) END, 6) AS value FROM e""")
def asof_modulo_month(spark, folder):
    """A list of three days of the month, in months of any length."""
    day, length = asof.in_month(F.col("ts"))
    return table(spark, folder, "events").select("event_id", F.round(asof.interpolate_modulo([(2.0, 10.0), (12.0, 25.0), (25.0, 40.0)], day, length), 6).alias("value"))
