"""Small text files: their lines in order, and tables of masked blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``line, text``: the lines of a small file, from 1, as they stand (an end of line at the end ends nothing)."""
    whole = spark.read.text(path, wholetext=True)
    text = F.regexp_replace("value", r"\r?\n\z", "")
    return whole.select(F.posexplode(F.split(text, r"\r?\n")).alias("line", "text")).select((F.col("line") + 1).alias("line"), "text")


def mask_table(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, ...]]:
    """``(i, j[, tile])`` of the masked blocks, from 1, and the layout ``(nx, ny)``.

    The first line says how many blocks are masked, the second the layout, and each other
    one names a block; blank lines and those that begin with ``#`` do not count. Another
    number of blocks than the first line says, a block outside the layout and one that
    is named twice are errors.
    """
    kept = lines_of(spark, path).where("trim(text) <> '' and not ltrim(text) like '#%'")
    numbers = F.transform(F.split(F.trim("text"), r"[\s,]+"), lambda x: x.try_cast("int"))
    rows = [r for r in kept.select("line", numbers.alias("n")).orderBy("line").limit(2).collect()]
    if len(rows) < 2 or len(rows[0].n) != 1 or len(rows[1].n) != 2:
        raise ValueError(f"{path}: the number of masked blocks and the layout come first")
    (count,), layout = rows[0].n, tuple(rows[1].n)
    blocks = kept.where(F.col("line") > rows[1].line).select(numbers.alias("n"))
    found = blocks.agg(
        F.count("*").alias("rows"), F.count_distinct("n").alias("distinct"), F.min(F.size("n")).alias("least"), F.max(F.size("n")).alias("most"),
        F.coalesce(F.bool_and(F.coalesce(F.get("n", F.lit(0)).between(1, layout[0]) & F.get("n", F.lit(1)).between(1, layout[1]), F.lit(False))), F.lit(True)).alias("inside"),
    ).first()
    if found["rows"] != count:
        raise ValueError(f"{path}: {count} masked blocks are said, {found['rows']} named")
    if count and (not found["inside"] or found["distinct"] != count or found["least"] != found["most"] or found["least"] not in (2, 3)):
        raise ValueError(f"{path}: a block lies outside the layout, is named twice or is no block")
    wide = count > 0 and found["most"] == 3
    names = ("i", "j", "tile") if wide else ("i", "j")
    return blocks.select(*[F.element_at("n", k + 1).alias(c) for k, c in enumerate(names)]), layout
