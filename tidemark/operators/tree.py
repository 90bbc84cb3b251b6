"""A tree of named values as a table: ``path, index, value, type``, a row a value.

Paths are ``/a/b/c``; a list is a path with values below it. What a tree is asked comes
as a table too, so that thousands of models' settings are read, defaulted, copied and
checked by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("path", "index", "value", "type")
#: Keys that the paths below one list are dealt over.
SALTS = 32


def tidy(path: Column) -> Column:
    """A path with one slash before each part and none at its end."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(path, "/"), lambda x: x != ""), "/"))


def ancestors(path: Column) -> Column:
    """The lists that a tidy path lies in, the root first, and itself."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))


def put(tree: DataFrame, changes: DataFrame, protect: bool = False) -> DataFrame:
    """``tree`` with ``changes(path, index, value, type)``: a null index replaces all values of a path.

    With ``protect`` a path that has values keeps them, and only new ones come in. A change
    behind the end of an array appends to it; a gap is an error.
    """
    changes = changes.withColumn("path", tidy(F.col("path")))
    if protect:
        new = changes.join(tree.select("path").distinct(), "path", "left_anti").withColumn("index", F.coalesce("index", F.lit(0)))
        return tree.select(*COLUMNS).unionByName(new.select(*COLUMNS))
    whole = changes.where(F.col("index").isNull())
    one = changes.where(F.col("index").isNotNull())
    rest = tree.join(whole.select("path").distinct(), "path", "left_anti").join(one.select("path", "index"), ["path", "index"], "left_anti")
    out = rest.select(*COLUMNS).unionByName(one.select(*COLUMNS)).unionByName(whole.withColumn("index", F.lit(0)).select(*COLUMNS))
    sizes = out.groupBy("path").agg(F.count("*").alias("n"), F.max("index").alias("last"))
    gaps = sizes.where("last >= n").select("path", F.lit(True).alias("gap"))
    checked = out.join(gaps, "path", "left")
    place = F.when(F.col("gap"), F.raise_error(F.concat(F.lit("a gap in "), F.col("path"))).cast("int")).otherwise(F.col("index"))
    return checked.select("path", place.alias("index"), "value", "type")


def get(tree: DataFrame, wanted: DataFrame, kind: str | None = None) -> DataFrame:
    """``wanted(path, index, default)`` with ``value``: of that place, or the default.

    With ``kind`` a value of another type is an error.
    """
    asked = wanted.withColumn("__path", tidy(F.col("path"))).withColumn("__index", F.coalesce("index", F.lit(0)))
    held = tree.select(F.col("path").alias("__path"), F.col("index").alias("__index"), "value", "type")
    value = F.coalesce("value", "default")
    if kind is not None:
        wrong = F.concat(F.col("__path"), F.lit(" is of type "), F.col("type"))
        value = F.when(F.col("type") != kind, F.raise_error(wrong).cast("string")).otherwise(value)
    return asked.join(held, ["__path", "__index"], "left").select(*wanted.columns, value.alias("value"))


def exists(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(path)`` with ``exists``, ``is_list`` and ``length``, the number of a path's values."""
    known = tree.select(F.explode(ancestors(F.col("path"))).alias("__path"), "path").groupBy("__path")
    known = known.agg(F.count_if(F.col("path") == F.col("__path")).alias("length"), F.bool_or(F.col("path") != F.col("__path")).alias("is_list"))
    out = wanted.withColumn("__path", tidy(F.col("path"))).join(known, "__path", "left")
    return out.select(*wanted.columns, F.col("length").isNotNull().alias("exists"), F.coalesce("is_list", F.lit(False)).alias("is_list"), F.coalesce("length", F.lit(0)).alias("length"))


def children(tree: DataFrame, lists: DataFrame) -> DataFrame:
    """``path, name``: the names directly in each list of ``lists(path)``."""
    steps = ancestors(F.col("path"))
    pairs = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.struct(F.element_at(steps, n).alias("parent"), F.element_at(steps, n + 1).alias("child")))
    links = tree.where("path <> '/'").select(F.explode(pairs).alias("p")).select("p.parent", F.element_at(F.split("p.child", "/"), -1).alias("name")).distinct()
    asked = lists.select("path", tidy(F.col("path")).alias("parent")).distinct()
    return asked.join(links, "parent").select("path", "name")


def copy(tree: DataFrame, pairs: DataFrame, move: bool = False) -> DataFrame:
    """``tree`` with what lies at and below ``pairs(old, new)``'s old paths at their new ones too, or (``move``) there alone.

    What was at the new paths gives way. Where each path goes is found once a path, not once
    a value; what lies below one list is dealt out over ``SALTS`` keys.
    """
    pairs = pairs.select(tidy(F.col("old")).alias("old"), tidy(F.col("new")).alias("new"))
    paths = tree.select("path").distinct()
    salt = F.pmod(F.hash("path"), F.lit(SALTS))
    placed = paths.select("path", F.explode(ancestors(F.col("path"))).alias("at"), salt.alias("salt"))
    # merge joins: Spark takes a tree of repeated texts for small and would send it through the driver
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    made = placed.join(salted(pairs.withColumnRenamed("old", "at")), ["at", "salt"])
    made = made.select("path", F.concat("new", F.substr("path", F.length("at") + 1)).alias("to"))
    gone = pairs.select(F.col("new").alias("at"))
    if move:
        gone = gone.unionByName(pairs.select(F.col("old").alias("at")))
    covered = placed.join(salted(gone.distinct()), ["at", "salt"]).select("path").distinct()
    kept = paths.join(covered.hint("merge"), "path", "left_anti")
    goes = kept.select("path", F.col("path").alias("to")).unionByName(made).withColumnRenamed("path", "__from")
    out = tree.join(goes.hint("merge"), F.col("path").eqNullSafe(F.col("__from")))
    return out.select(F.col("to").alias("path"), "index", "value", "type")


def unknown(tree: DataFrame, lists: DataFrame, allowed: DataFrame) -> DataFrame:
    """``path, name``: names in the lists of ``lists(path)`` that ``allowed(name)`` does not have."""
    return children(tree, lists).join(allowed.select("name").distinct(), "name", "left_anti").select("path", "name")
