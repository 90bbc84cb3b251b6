"""Reports in text: columns of a field at points, area means line by line, YAML of three levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diagnostic_columns(cells: DataFrame, points: list[tuple[str, float, float]] = (), indices: list[tuple[str, int, int]] = ()) -> DataFrame:
    """Rows of ``cells(i, j, lon0, lon1, lat0, lat1, ...)`` whose cell a point lies in, with the point's ``name``.

    ``points`` are ``(name, lon, lat)`` in degrees, ``indices`` ``(name, i, j)``; there are a few of
    them, and each row looks them up by itself. A cell has its western and southern edges;
    the last ones to the north belong to it at the pole. Longitudes wrap. Coordinates out of
    range are an error.
    """
    for name, lon, lat in points:
        if not (0 <= lon <= 360 and -90 <= lat <= 90):
            raise ValueError(f"{name}: longitudes are 0 to 360, latitudes -90 to 90")
    place = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for n, x, y in points]) if points else None
    names = []
    if points:
        def inside(p: Column) -> Column:
            east = F.pmod(p["x"] - F.col("lon0"), F.lit(360.0)) < F.col("lon1") - F.col("lon0")
            north = (p["y"] >= F.col("lat0")) & ((p["y"] < F.col("lat1")) | ((p["y"] == 90) & (F.col("lat1") == 90)))
            return east & north

        names.append(F.transform(F.filter(place, inside), lambda p: p["name"]))
    names += [F.array_compact(F.array(*[F.when((F.col("i") == i) & (F.col("j") == j), F.lit(n)) for n, i, j in indices]))] if indices else []
    if not names:
        return cells.select(F.lit("").alias("name"), *cells.columns).where("false")
    return cells.select(F.explode(F.concat(*names)).alias("name"), *cells.columns)


def average_lines(df: DataFrame, time: str, fields: list[tuple[str, str]], value: str = "value", area: str = "area", label: str = "field", a_line: int = 4, wide: int = 9) -> DataFrame:
    """``time, part, line``: area means of fields in text, a line a time and ``a_line`` fields.

    ``fields`` are names and printf formats, in the order of printing; the time is printed
    with three digits, or with an exponent if it has ``wide`` digits before its point. A
    field without a valid value at a time is an error: it has not been summed.
    """
    known = [F.when((F.col(label) == name) & F.col(value).isNotNull(), F.col(area)) for name, _ in fields]
    sums = df.groupBy(time).agg(*[(F.sum(F.col(value) * w) / F.nullif(F.sum(w), F.lit(0.0))).alias(f"__{n}") for n, w in enumerate(known)])
    t = F.col(time).cast("double")
    begin = F.when(F.abs(t) >= 10.0**wide, F.format_string("%15.6e", t)).otherwise(F.format_string("%11.3f", t))
    parts = []
    for at in range(0, len(fields), a_line):
        texts = []
        for n in range(at, min(at + a_line, len(fields))):
            none = F.raise_error(F.concat(F.lit(f"{fields[n][0]}: no value at "), F.col(time).cast("string"))).cast("string")
            texts.append(F.when(F.col(f"__{n}").isNull(), none).otherwise(F.format_string(fields[n][1], F.col(f"__{n}"))))
        parts.append(F.struct(F.lit(at // a_line).alias("part"), F.concat(begin, *texts).alias("line")))
    return sums.select(time, F.explode(F.array(*parts)).alias("l")).select(time, "l.part", "l.line")


def yaml_text(items: DataFrame, document: str, outer: str, inner: str, title: dict[str, str] | None = None) -> DataFrame:
    """``document, text``: three levels of ``items(document, place, item, key, value, sub)`` as YAML.

    A document is scalars (``title``), and under ``outer`` a list of maps; a row with ``sub`` is
    a key of the map ``sub`` in the list ``inner`` of its item, one without a key of the item
    itself. Keys are in the order of ``place``. Texts that YAML would read as something else,
    or that hold its signs, are quoted. Null values are left out.
    """
    plain = F.col("value").rlike(r"^[A-Za-z_][A-Za-z0-9_ %./-]*$") & ~F.lower("value").isin("true", "false", "yes", "no", "on", "off", "null", "y", "n") & ~F.col("value").rlike(" $")
    number = F.col("value").rlike(r"^-?(0|[1-9][0-9]*)([.][0-9]+)?$")
    shown = F.when(plain | number, F.col("value")).otherwise(F.concat(F.lit("'"), F.replace("value", F.lit("'"), F.lit("''")), F.lit("'")))
    rows = items.where(F.col("value").isNotNull()).withColumn("pair", F.concat("key", F.lit(": "), shown))
    joined = lambda sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "pair"))), lambda x: x["pair"]), sep)
    subs = rows.where("sub is not null").groupBy("document", "item", "sub").agg(joined("\n    ").alias("pairs"), F.min("place").alias("place"))
    subs = subs.withColumn("pair", F.concat(F.lit("  - "), F.col("pairs"))).groupBy("document", "item").agg(joined("\n").alias("subs"))
    own = rows.where("sub is null").groupBy("document", "item").agg(joined("\n  ").alias("own"), F.min("place").alias("place"))
    both = own.join(subs, ["document", "item"], "left")
    pair = F.concat(F.lit("- "), F.col("own"), F.coalesce(F.concat(F.lit(f"\n  {inner}:\n"), F.col("subs")), F.lit("")))
    out = both.withColumn("pair", pair).groupBy("document").agg(joined("\n").alias("items"))
    head = "".join(f"{k}: {v}\n" for k, v in (title or {}).items())
    return out.select(F.col("document").alias(document), F.concat(F.lit(f"{head}{outer}:\n"), F.col("items"), F.lit("\n")).alias("text"))
