"""Field arithmetic: masks, rescaling, increments, packing, and declarative overrides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def masked(value: Column, mask: Column | None = None, weight_mask: Column | None = None) -> Column:
    """Null where a logical mask is false or a real mask under one half; not both."""
    if mask is not None and weight_mask is not None:
        raise ValueError("give a logical or a real mask, not both")
    if mask is not None:
        return F.when(mask, value)
    return value if weight_mask is None else F.when(weight_mask >= 0.5, value)


def rescale(value: Column, scale: Column | float) -> Column:
    """value * scale; exactly zero if the scale is zero, whatever the value (NaN too)."""
    scale = F.lit(scale) if not isinstance(scale, Column) else scale
    return F.when(scale == 0, F.lit(0.0)).otherwise(scale * value)


def increment(base: DataFrame, more: DataFrame, keys: list[str], value: str, scale: float = 1.0, scale_prev: float = 1.0) -> DataFrame:
    """scale_prev * base + scale * more, cell by cell; cells without ``more`` add nothing."""
    joined = base.join(more.withColumnRenamed(value, "__more"), keys, "left")
    new = F.col(value) * F.lit(scale_prev) + F.coalesce(F.col("__more"), F.lit(0.0)) * F.lit(scale)
    return joined.withColumn(value, new).drop("__more")


def weighted_increment(base: DataFrame, layers: DataFrame, keys: list[str], level: str, value: str, weight: str, scale: float = 1.0, scale_prev: float = 1.0) -> DataFrame:
    """Fold layers into a 2-D field: at each level, in order, scale_prev * x + scale * w * layer."""
    lists = layers.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(level, (F.col(weight) * F.col(value)).alias("__wx")))).alias("__layers"))
    joined = base.join(lists, keys, "left")
    layers_or_none = F.coalesce(F.col("__layers"), F.array())
    folded = F.aggregate(layers_or_none, F.col(value), lambda x, y: x * F.lit(scale_prev) + y["__wx"] * F.lit(scale))
    return joined.withColumn(value, folded).drop("__layers")


def unpack(value: Column, scale_factor: float | None, add_offset: float | None) -> Column:
    """Packed integers to values; both attributes are needed if either is there."""
    if (scale_factor is None) != (add_offset is None):
        raise ValueError("scale_factor and add_offset come together")
    return value if scale_factor is None else value * F.lit(scale_factor) + F.lit(add_offset)


def is_valid(value: Column, low: float | None = None, high: float | None = None, fill: float | None = None) -> Column:
    out = value.isNotNull()
    if low is not None:
        out &= value >= low
    if high is not None:
        out &= value <= high
    return out if fill is None else out & (value != fill)


def to_points(grid: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """A structured field on the listed points ``(point, keys)`` only."""
    return points.join(grid, keys)


def to_grid(values: DataFrame, points: DataFrame, grid: DataFrame, keys: list[str], value: str, fill: float | None = None) -> DataFrame:
    """Point values back on the whole grid; cells without a point hold ``fill``."""
    placed = points.join(values, "point").select(*keys, value)
    out = grid.select(*keys).join(placed, keys, "left")
    return out if fill is None else out.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def masked_blocks(blocks: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks that a mask table does not list."""
    return blocks.join(table, keys, "left_anti")


def remove_and_add(df: DataFrame, remove: DataFrame, add: DataFrame, key: str) -> DataFrame:
    return df.join(remove.select(key), key, "left_anti").unionByName(add)


@dataclass(frozen=True)
class Override:
    """One row of an override table; without a source the field is the constant ``factor``."""

    grid: str
    field: str
    source: str | None
    factor: float = 1.0
    region: tuple[float, float, float, float] | None = None
    outside: bool = False


def first_match(table: list[Override], grid: str, field: str) -> Override | None:
    return next((o for o in table if (o.grid, o.field) == (grid, field)), None)


def override(model: DataFrame, table: list[Override], grid: str, field: str, value: str, source: DataFrame | None = None, keys: list[str] | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The model's field replaced as the first matching row of the table says.

    ``source(keys, value)`` holds the file's field at the wanted time on the model's
    grid (see ``asof`` and ``regrid``). In a region only its inside (or outside) is
    replaced, and cells the file lacks keep the model's value; without a region they
    become null.
    """
    row = first_match(table, grid, field)
    if row is None:
        return model
    if row.source is None:
        joined, new = model, F.lit(float(row.factor))
    else:
        joined = model.join(source.withColumnRenamed(value, "__new"), keys, "left")
        new = F.col("__new") * F.lit(float(row.factor))
    if row.region:
        w, e, s, n = row.region
        inside = F.col(lon).between(w, e) & F.col(lat).between(s, n)
        chosen = ~inside if row.outside else inside
        new = F.when(chosen & new.isNotNull(), new).otherwise(F.col(value))
    return joined.withColumn(value, new).drop("__new")


def override_from(model: DataFrame, table: list[Override], grid: str, field: str, value: str, slices: DataFrame, x_axis: list[float], y_axis: list[float], period: int | None = None, cyclic: float | None = None) -> DataFrame:
    """``override`` from a file as it is: onto the model's cells, in time, then factor and region, in one call.

    ``model(dst, t, lon, lat, value)`` may hold several levels of a cell ``dst``: a field
    without levels goes to each. ``slices(t, i, j, value)`` is on the axes' points
    (counted from 0); slice times are the short list, cyclic with ``period``. Each slice
    is regridded once (missing corners lend their weight to the others); a cell is
    replaced only where both slices around the time have a value there.
    """
    from tidemark.operators.asof import interpolate_list, intervals
    from tidemark.operators.regrid import apply_weights, bilinear_weights

    if first_match(table, grid, field) is None:
        return model
    times = slices.select("t").distinct().withColumn("x", F.col("t").cast("double"))
    spans = intervals(times, "t", "x", period).withColumns({"s1": F.col("x1"), "s2": F.col("x2"), "a": F.col("t1").cast("double"), "b": F.col("t2").cast("double")})
    u = F.pmod("t", F.lit(period)) if period is not None else F.col("t")
    placed = interpolate_list(model.select("t").distinct().withColumn("__u", u), spans, F.col("__u")).where("s1 is not null")
    w = (F.col("__u") - F.col("a")) / (F.col("b") - F.col("a"))
    shares = placed.select("t", "s1", "s2", w.alias("part"))
    # each slice is regridded once, whatever times ask for it
    weights = bilinear_weights(model.select("dst", "lon", "lat").distinct(), x_axis, y_axis, "lon", "lat", cyclic=cyclic)
    weights = weights.select("dst", (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), "w")
    held = slices.where(F.col(value).isNotNull()).select(F.col("t").cast("double").alias("slice"), "i", "j", value)
    cells = held.join(weights, ["i", "j"]).groupBy("slice", "dst")
    cells = cells.agg((F.sum(F.col(value) * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("x"))
    both = between_records(cells, shares, ["dst"])
    return override(model, table, grid, field, value, both.withColumnRenamed("x", value), ["t", "dst"])


def between_records(records: DataFrame, shares: DataFrame, keys: list[str]) -> DataFrame:
    """``t, keys, x``: ``records(slice, keys, x)`` linear in time, by ``shares(t, s1, s2, part)``.

    ``part`` is the second record's weight. Both records must hold a value, else ``x`` is
    null, even where one of them has no weight.
    """
    parts = F.array(F.struct(F.col("s1").alias("slice"), (1 - F.col("part")).alias("w")), F.struct(F.col("s2").alias("slice"), F.col("part").alias("w")))
    wanted = shares.select("t", F.explode(parts).alias("p")).select("t", "p.slice", "p.w")
    sums = records.join(wanted, "slice").groupBy("t", *keys).agg(F.sum(F.col("x") * F.col("w")).alias("x"), F.count("x").alias("n"))
    return sums.withColumn("x", F.when(F.col("n") == 2, F.col("x"))).drop("n")


def column_burden(layers: DataFrame, keys: list[str], gravity: float = 9.80, per_area: bool = False) -> DataFrame:
    """Mass above an area of ``layers(keys, top, bottom, q)``; ``per_area`` where ``q`` is a layer's mass already."""
    mass = F.col("q") if per_area else F.col("q") * (F.col("bottom") - F.col("top")) / gravity
    return layers.groupBy(*keys).agg(F.sum(mass).alias("burden"))


def interpolate_vertical(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Layer means by mass: ``source(keys, top, bottom, q)`` onto ``target(keys, k, top, bottom)``.

    Layers of a column meet by column, so the range condition is checked within it. A
    target that touches a null layer is null.
    """
    t = target.select(*keys, "k", F.col("top").alias("t_top"), F.col("bottom").alias("t_bottom"))
    low, high = F.greatest("top", "t_top"), F.least("bottom", "t_bottom")
    part = F.greatest(high - low, F.lit(0.0)) * F.col("q") / (F.col("t_bottom") - F.col("t_top"))
    joined = t.join(source, keys)
    gap = F.bool_or((high > low) & F.col("q").isNull())
    return joined.groupBy(*keys, "k").agg(F.when(~gap, F.coalesce(F.sum(part), F.lit(0.0))).alias("value"))


def linear_vertical(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Linear in a column's levels ``source(keys, p, q)`` at ``target(keys, k, p)``; ends extrapolate."""
    order = Window.partitionBy(*keys).orderBy("p")
    s = source.select(
        *keys, F.col("p").alias("p1"), F.col("q").alias("q1"), F.lead("p").over(order).alias("p2"), F.lead("q").over(order).alias("q2"),
        F.row_number().over(order).alias("n"), F.count("*").over(Window.partitionBy(*keys)).alias("of"),
    ).where("p2 is not null")
    first, last = F.col("n") == 1, F.col("n") == F.col("of") - 1
    inside = ((F.col("p") >= F.col("p1")) | first) & ((F.col("p") < F.col("p2")) | last)
    x = F.col("q1") + (F.col("p") - F.col("p1")) * (F.col("q2") - F.col("q1")) / (F.col("p2") - F.col("p1"))
    return target.join(s, keys).where(inside).select(*keys, "k", x.alias("value"))
