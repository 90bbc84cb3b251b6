"""Registries as tables: tracers and their parameters, exchanged fields, fluxes and their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.fields import Override


def numbered(entries: DataFrame, group: str, name: str, place: str, strict: bool = False) -> DataFrame:
    """``group, name, number``: names of each group from 1 in the order of their first place.

    With ``strict`` a name given twice in a group is an error. A registry holds as many
    rows as a model has fields, so each group is sorted in one task.
    """
    first = entries.groupBy(group, name).agg(F.min(place).alias("__place"), F.count("*").alias("__n"))
    number = F.row_number().over(Window.partitionBy(group).orderBy("__place", name))
    if strict:
        twice = F.concat(F.lit("registered twice: "), F.col(name).cast("string"))
        number = F.when(F.col("__n") > 1, F.raise_error(twice)).otherwise(number)
    return first.select(group, name, number.alias("number"))


def index_of(registry: DataFrame, wanted: DataFrame, group: str, name: str) -> DataFrame:
    """``wanted`` with each name's number; a name that is not registered has null."""
    return wanted.join(registry.select(group, name, "number"), [group, name], "left")


def parameter(values: DataFrame, keys: list[str], names: dict[str, str | None], label: str = "parameter", value: str = "value", place: str = "place") -> DataFrame:
    """One row a key with the named parameters as columns, or their defaults.

    Of a parameter given more than once the last by ``place`` holds.
    """
    last = [F.coalesce(F.max_by(F.when(F.col(label) == n, F.col(value)), F.when(F.col(label) == n, F.col(place))), F.lit(d)).alias(n) for n, d in names.items()]
    return values.groupBy(*keys).agg(*last)


def tracer_table(values: DataFrame) -> DataFrame:
    """Tracers of ``values(place, model, tracer, parameter, value)``, numbered within each model.

    ``model, tracer, number, longname, units, prognostic``: a tracer without a long name
    has its own name and one without units ``none``; one whose ``tracer_type`` is
    diagnostic is not prognostic.
    """
    known = parameter(values, ["model", "tracer"], {"longname": None, "units": "none", "tracer_type": "prognostic"})
    known = known.join(numbered(values, "model", "tracer", "place"), ["model", "tracer"])
    prognostic = F.lower("tracer_type") != "diagnostic"
    return known.select("model", "tracer", "number", F.coalesce("longname", "tracer").alias("longname"), "units", prognostic.alias("prognostic"))


def tracer_counts(tracers: DataFrame) -> DataFrame:
    """``model, total, prognostic, diagnostic``."""
    known = F.count_if(F.col("prognostic"))
    return tracers.groupBy("model").agg(F.count("*").alias("total"), known.alias("prognostic"), (F.count("*") - known).alias("diagnostic"))


def chosen_fluxes(meta: DataFrame, exclude: str | None = None, only: str | None = None, pass_through_ice: bool | None = None) -> Column:
    """Which rows of ``meta(flux_type, pass_through_ice)`` an operation takes: all given conditions hold.

    Trailing blanks do not count; a null type is no type and a null flag fits neither answer.
    """
    kind, chosen = F.rtrim(meta["flux_type"]), F.lit(True)
    if exclude is not None:
        chosen &= ~kind.eqNullSafe(exclude.rstrip())
    if only is not None:
        chosen &= kind.eqNullSafe(only.rstrip())
    if pass_through_ice is not None:
        chosen &= meta["pass_through_ice"].eqNullSafe(pass_through_ice)
    return chosen


def select_fields(fields: DataFrame, meta: DataFrame, bc: int | None = None, field: int | None = None, **conditions) -> DataFrame:
    """Rows of ``fields(bc, field, ...)`` whose boundary condition ``meta(bc, flux_type, pass_through_ice)`` is taken.

    ``bc`` and ``field`` are numbers of one condition and one field in it; a field alone is an error.
    """
    if field is not None and bc is None:
        raise ValueError("a field is numbered within a boundary condition")
    taken = meta.where(chosen_fluxes(meta, **conditions)).select("bc")
    out = fields.join(taken, "bc", "left_semi")
    if bc is not None:
        out = out.where(F.col("bc") == bc)
    return out if field is None else out.where(F.col("field") == field)


def extract(fields: DataFrame, bc: int, field: int, level: int | None = None, scale: float = 1.0) -> DataFrame:
    """The scaled values of one field, or of one level of it: ``i, j[, k], value``."""
    one = fields.where((F.col("bc") == bc) & (F.col("field") == field))
    value = (F.col("value") * scale).alias("value")
    return one.select("i", "j", "k", value) if level is None else one.where(F.col("k") == level).select("i", "j", value)


def set_field(fields: DataFrame, data: DataFrame, bc: int, field: int, scale: float = 1.0, level: int | None = None) -> DataFrame:
    """``fields`` with scaled ``data(i, j[, k], value)`` in one field; without ``k`` it goes to ``level``, or to all levels."""
    given = data.select(*[c for c in ("i", "j", "k") if c in data.columns], (F.col("value") * scale).alias("__new"))
    here = (F.col("bc") == bc) & (F.col("field") == field)
    if level is not None:
        here &= F.col("k") == level
    joined = fields.join(given, [c for c in ("i", "j", "k") if c in data.columns], "left")
    return joined.select(*[F.when(here, F.coalesce("__new", "value")).otherwise(F.col("value")).alias("value") if c == "value" else F.col(c) for c in fields.columns])


def override_conditions(fields: DataFrame, names: DataFrame, table: list[Override], grid: str, files: DataFrame | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``fields(bc, field, i, j, ...)`` with those replaced that the override table names on a grid.

    ``names(bc, field, name)`` are the fields' names, ``files(name, i, j[, k], value)`` what their
    files hold at the time, on the grid. For each name the first row of the table holds: a
    constant, or the file's value times the factor. In a region only its inside (or outside)
    is replaced, and there only where the file has a value; without one, cells that the
    file lacks become null. Other fields stay.
    """
    first: dict[str, Override] = {}
    for row in table:
        if row.grid == grid:
            first.setdefault(row.field, row)
    if not first:
        return fields
    named = fields.join(names.select("bc", "field", "name"), ["bc", "field"], "left")
    if files is not None:
        keys = ["name", *[c for c in ("i", "j", "k") if c in files.columns]]
        named = named.join(files.select(*keys, F.col("value").alias("__file")), keys, "left")
    else:
        named = named.withColumn("__file", F.lit(None).cast("double"))
    value = F.col("value")
    for name, row in first.items():
        new = F.lit(float(row.factor)) if row.source is None else F.col("__file") * float(row.factor)
        here = F.col("name") == name
        if row.region:
            w, e, s, n = row.region
            inside = F.col(lon).between(w, e) & F.col(lat).between(s, n)
            here = here & (~inside if row.outside else inside) & new.isNotNull()
        value = F.when(here, new).otherwise(value)
    return named.select(*[value.alias("value") if c == "value" else F.col(c) for c in fields.columns])


def spawn(meta: DataFrame, cells: DataFrame, fill: float = 0.0) -> DataFrame:
    """A field table of the same conditions and fields over other cells, filled with one value.

    ``meta(bc, n_fields)`` and ``cells(i, j, k)`` give ``bc, field, i, j, k, value``; the
    fields are an array spread in the row, so cells are read once and nothing shuffles.
    """
    held = sorted((r.bc, f) for r in meta.select("bc", "n_fields").collect() for f in range(1, r.n_fields + 1))  # as many as a model has fields
    every = F.array(*[F.struct(F.lit(b).cast("long").alias("bc"), F.lit(f).alias("field")) for b, f in held])
    return cells.select(F.explode(every).alias("one"), "i", "j", "k").select("one.bc", "one.field", "i", "j", "k", F.lit(float(fill)).alias("value"))
