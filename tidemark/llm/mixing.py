"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: the sources share the corpus's size by weight; a source is filled up to a
multiple of its own size and the excess goes to the others by weight, until none is
above (water filling). Sorted by limit over weight the filled sources come first, so
running sums over the distinct ratios find the level.

Sampling: a row's key is an exponential variate divided by its quality weight; the
rows of a source in key order are a weighted sample without replacement. A source
takes its whole complete epochs first, then the shortest key prefix that reaches
the rest of its budget. The prefix is found in two steps that no source, however
large, brings to one task: sums per cell of key space (partially aggregated) place
the budget in a cell, and only that cell's rows are sorted. Cells divide the
logarithm of the key, so that weights of any scale spread over them alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_table, with_ranks

WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3
CELLS_AN_OCTAVE, BLOCK_BITS = 4096, 9
CELLS_A_RATIO_OCTAVE = 64
LEAST_WEIGHT = 1e-9
SYMBOLS = "#*$%&|<>"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null has none."""
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    words = F.size(F.split(trimmed, WORD_SPLIT))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, 0).otherwise(words).cast("long")


def uniform(*columns: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the columns' values and the seed only."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def text_quality(text: Column) -> Column:
    """A quality weight from 0.05 to 1: the share of lines that are no repeats, less for symbols.

    Ten symbols (``#*$%&|<>``) in a hundred words halve the weight. Null and blank texts
    have the weight of a text without repeats; they have no words to draw.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x) != "")
    fresh = F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    weight = fresh / (1 + 10 * symbols / F.greatest(word_count(text), F.lit(1)))
    return F.when(F.size(lines) > 0, F.greatest(weight, F.lit(0.05))).otherwise(1.0)


def draw_key(weight: Column, *columns: Column, seed: int) -> Column:
    """An exponential variate divided by the weight: the least keys are drawn first."""
    weight = F.greatest(F.coalesce(weight, F.lit(1.0)), F.lit(LEAST_WEIGHT))
    return -F.log(uniform(*columns, seed=seed)) / weight


def cell_of(key: Column) -> Column:
    return F.floor(F.log2(key) * CELLS_AN_OCTAVE).cast("int")


def targets(sources: DataFrame, weights: tuple[float, ...], limit: float) -> DataFrame:
    """``sources(source, source_size)`` with ``target``: one row per source, null last.

    The level of the water is that of the first ratio of limit to weight which it does
    not exceed. Sources of one ratio are one row of the running sums, so ties share one
    level. Sums run over cells of the ratio's logarithm and then within a cell; no task
    holds all sources. An empty or textless table has targets of 0.
    """
    order = [F.col("source").isNull().alias("last"), F.col("source").cast("binary").alias("bytes")]
    s = with_ranks(sources, order)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.lit(float(limit)) * F.col("source_size"))
    s = shared_table(s.withColumn("ratio", F.col("most") / F.col("weight")), "mix-sources")

    total, all_weight = s.agg(F.sum(F.col("source_size").cast("double")), F.sum("weight")).first()
    cell = F.when(F.col("ratio") > 0, F.floor(F.log2("ratio") * CELLS_A_RATIO_OCTAVE)).otherwise(-(1 << 20)).cast("int")
    ratios = s.groupBy("ratio").agg(F.sum("most").alias("most"), F.sum("weight").alias("weight")).withColumn("cell", cell)
    cells = ratios.groupBy("cell").agg(F.sum("most").alias("cell_most"), F.sum("weight").alias("cell_weight"))
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # some 64 rows an octave of ratios
    cells = cells.select("cell", *[F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(f"before_{c}") for c in ("cell_most", "cell_weight")])
    upto = Window.partitionBy("cell").orderBy("ratio").rowsBetween(Window.unboundedPreceding, -1)
    within = [F.coalesce(F.sum(c).over(upto), F.lit(0.0)).alias(f"in_{c}") for c in ("most", "weight")]
    ratios = ratios.select("cell", "ratio", *within).join(cells, "cell")
    left = F.lit(total) - F.col("before_cell_most") - F.col("in_most")
    level = left / (F.lit(all_weight) - F.col("before_cell_weight") - F.col("in_weight"))
    found = ratios.withColumn("level", level).where("level <= ratio").agg(F.min(F.struct("ratio", "level")).alias("least")).first()["least"]
    fair = F.least("most", F.lit(found["level"]) * F.col("weight")) if found else F.col("most")
    return s.select("source", "source_size", fair.alias("target"))


def mix_sources(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    limit: int = LIMIT,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep_tie: bool = False,
    weight: Column | None = None,
) -> DataFrame:
    """What the mix takes of each row: ``doc_id, size, source, source_size, target, taken``.

    Quality weights are a column of ``docs`` (``weight``, such as ``text_quality``) or a
    table ``quality(doc_id, quality_weight)``, where of several for an id the largest
    holds. Rows without one weigh 1; weights of zero or less count as the smallest,
    so that such rows are drawn last. Sources are ordered by code
    point, null (its own source) last, and weigh ``weights`` in turn. ``taken`` is
    ``size`` times the complete epochs, plus ``size`` once more for rows in the
    selection, so it never exceeds ``limit`` times ``size``. The row that crosses
    the budget is taken only if that brings the source closer to it. Rows with equal
    keys (repeated ids) are ordered by size and text hash. Null or blank texts have
    size 0 and take 0. An empty table gives an empty result. Other columns are
    ignored. Reruns with the same seed agree. ``keep_tie`` adds the text hash.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("tie"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("quality_weight"),
    )
    if quality is not None:
        best = quality.groupBy("doc_id").agg(F.max("quality_weight").alias("quality_weight"))
        sized = sized.drop("quality_weight").join(best, "doc_id", "left")
    draw = draw_key(F.col("quality_weight"), F.col("doc_id"), seed=seed)
    sized = shared_table(sized.withColumn("key", draw).withColumn("cell", cell_of(F.col("key"))), "mix-sized")

    cells = sized.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    sources = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    plan = targets(sources, weights, limit)
    size = F.greatest(F.col("source_size"), F.lit(1))
    plan = plan.withColumn("epochs", F.floor(F.col("target") / size).cast("long"))
    plan = plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))

    # running sums in two steps, over blocks and within a block: 2 ** BLOCK_BITS rows a group or so
    block = F.shiftright("cell", BLOCK_BITS).alias("block")
    blocks = cells.groupBy("source", block).agg(F.sum("cell_size").alias("block_size"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("source").alias("of"), F.col("block").alias("of_block"), F.coalesce(F.sum("block_size").over(earlier), F.lit(0)).alias("blocks_before"))
    upto = Window.partitionBy("source", "block").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("block", block).withColumn("before", F.coalesce(F.sum("cell_size").over(upto), F.lit(0)))
    cells = cells.join(blocks, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block")))
    cells = cells.select("source", "cell", "cell_size", (F.col("before") + F.col("blocks_before")).alias("before"))
    # rows meet their plan by source and cell, so that a large source is many groups
    placed = cells.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    reach = F.col("before") + F.col("cell_size")
    state = F.when(F.col("before") > F.col("budget"), 1).when(reach > F.col("budget"), 0).otherwise(-1)
    placed = placed.select(F.col("source").alias("of"), F.col("cell").alias("of_cell"), "source_size", "target", "epochs", "budget", "before", state.alias("state"))
    placed = shared_table(placed, "mix-plan")

    rows = sized.join(placed, F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("of_cell"))).drop("of", "of_cell")
    inside = rows.where("state = 0")
    rank = Window.partitionBy("source").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(rank), F.lit(0))
    inside = inside.withColumn("chosen", (start + F.col("size") / 2 <= F.col("budget")) & (start < F.col("budget")))
    outside = rows.where("state <> 0").withColumn("chosen", F.col("state") < 0)
    taken = F.col("size") * (F.col("epochs") + F.col("chosen").cast("long"))
    more = ["quality_weight", "tie"] if keep_tie else ["quality_weight"]
    return outside.unionByName(inside).select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), *more)


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix, with all columns of ``docs``: each as often as it is taken.

    Rows weigh by ``text_quality``.

    Rows that take nothing go. Rows are told apart by id, source and a hash of the
    text; rows that repeat all three share what they take together, evenly.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    key, text, source = (f"c{columns.index(c)}" for c in (id_col, text_col, source_col))
    options = {"weight": text_quality(F.col(text_col))} | options
    mix = mix_sources(docs, None, id_col=id_col, text_col=text_col, source_col=source_col, keep_tie=True, **options)
    taken = mix.where("taken > 0").groupBy("doc_id", "source", "tie").agg(F.sum(F.col("taken") / F.col("size")).alias("times"), F.count("*").alias("rows"))
    taken = taken.select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), "tie", "times", "rows")
    same = F.col(key).eqNullSafe(F.col("m_id")) & F.col(source).eqNullSafe(F.col("m_source")) & (F.xxhash64(text) == F.col("tie"))
    times = F.ceil(F.col("times") / F.col("rows")).cast("int")
    joined = plain.join(taken, same).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    return joined.select(*[F.col(c).alias(n) for c, n in zip(plain.columns, columns)])
