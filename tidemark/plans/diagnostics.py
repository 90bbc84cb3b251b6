"""Declarative diagnostics: a YAML table to one DataFrame or stream per output file.

A source table has a row per sample: a time, cell columns, a variable name and a
value. Each variable of a file becomes an aggregate; variables of a file with the
same reduction share one aggregation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.reductions import even_share, reduction
from tidemark.operators.windows import CALENDAR_UNITS, UNITS, Months, Phase, file_name, later, micros, phase_end, section, span_end

METHODS = ("none", "min", "max", "sum", "average", "rms")


@dataclass(frozen=True)
class Variable:
    name: str
    method: str
    output: str
    zbounds: tuple[float, float] | None = None
    attributes: dict = field(default_factory=dict)


@dataclass(frozen=True)
class OutputFile:
    name: str
    freq: tuple[int, ...]
    duration: tuple[int, ...]
    variables: tuple[Variable, ...]
    start: str | None = None
    region: dict | None = None
    name_freq: int | None = None
    clock: bool = False


@dataclass(frozen=True)
class Plan:
    title: str
    base: str
    files: tuple[OutputFile, ...]


def _span(text: str | int, unit: str | None) -> int:
    """``"6 hours"`` or a number with a unit of its own to microseconds or months; 0 and -1 stay."""
    parts = str(text).split()
    n = int(parts[0])
    unit = parts[1] if len(parts) > 1 else unit
    if n <= 0:
        return n
    if unit in CALENDAR_UNITS:
        return Months(n * CALENDAR_UNITS[unit])
    if unit not in UNITS:
        raise ValueError(f"unknown time unit {unit!r}")
    return n * UNITS[unit]


def _spans(value: str | int | None, unit: str | None) -> tuple[int, ...]:
    if value is None:
        return ()
    return tuple(_span(x.strip(), unit) for x in str(value).split(","))


#: Columns of a region by its grid type.
REGION_COLUMNS = {"index": ("i", "j"), "latlon": ("lon", "lat")}


def _region(sub: dict | None) -> dict | None:
    """Ranges by column: of a region by corners (its bounding box) and tile, or as they are."""
    if not sub:
        return None
    if "grid_type" not in sub:
        return sub
    if sub["grid_type"] not in REGION_COLUMNS:
        raise ValueError(f"unknown grid type {sub['grid_type']!r}")
    corners = [c.split() if isinstance(c, str) else c for c in (sub[f"corner{n}"] for n in range(1, 5))]
    ranges = {name: (min(axis), max(axis)) for name, axis in zip(REGION_COLUMNS[sub["grid_type"]], zip(*[map(float, c) for c in corners]))}
    return ranges | ({"tile": (sub["tile"], sub["tile"])} if "tile" in sub else {})


def parse_plan(text: str) -> Plan:
    """Read and check a diagnostics table."""
    raw = yaml.safe_load(text)
    year, month, day, hour, minute, second = raw["base_date"] if isinstance(raw["base_date"], list) else map(int, str(raw["base_date"]).split())
    files = []
    for f in raw.get("diag_files", []):
        unit = f.get("freq_units")
        freq, duration = _spans(f["freq"], unit), _spans(f.get("file_duration"), f.get("file_duration_units", unit))
        if len(freq) > 1 and len(duration) != len(freq):
            raise ValueError(f"{f['file_name']}: as many durations as frequencies are needed")
        variables = []
        for v in f.get("varlist", []):
            method = v.get("reduction", f.get("reduction", "none"))
            if method not in METHODS and not re.fullmatch(r"(diurnal|pow)[1-9]\d*", method):
                raise ValueError(f"{v['var_name']}: unknown reduction {method!r}")
            bounds = v.get("zbounds")
            zbounds = tuple(map(float, bounds.split() if isinstance(bounds, str) else bounds)) if bounds else None
            variables.append(Variable(v["var_name"], method, v.get("output_name", v["var_name"]), zbounds, v.get("attributes", {})))
        names = [v.output for v in variables]
        if len(set(names)) != len(names):
            raise ValueError(f"{f['file_name']}: an output name is used twice")
        clock = bool(f.get("use_clock_average", False))
        if clock and not (len(freq) == 1 and freq[0] in (UNITS["hours"], UNITS["days"], Months(1), Months(12))):
            raise ValueError(f"{f['file_name']}: clock averages are of one hour, day, month or year")
        rotation = _spans(f.get("new_file_freq"), f.get("new_file_freq_units", unit))
        files.append(OutputFile(f["file_name"], freq, duration, tuple(variables), _start(f.get("start_time")), _region(f.get("sub_region")), rotation[0] if rotation else None, clock))
    return Plan(raw.get("title", ""), f"{year:04}-{month:02}-{day:02} {hour:02}:{minute:02}:{second:02}", tuple(files))


def _start(text) -> str | None:
    """``2 1 1 0 0 0`` or a list of six as an ISO date and time."""
    if text is None or (isinstance(text, str) and "-" in text):
        return text
    year, month, day, hour, minute, second = map(int, text.split() if isinstance(text, str) else text)
    return f"{year:04}-{month:02}-{day:02} {hour:02}:{minute:02}:{second:02}"


def _base_micros(base: str) -> int:
    import datetime

    return int(datetime.datetime.fromisoformat(base).replace(tzinfo=datetime.timezone.utc).timestamp()) * 1_000_000


def _ends(f: OutputFile, base: int, time: Column) -> Column:
    if f.freq[0] == 0:
        return time
    if f.freq[0] == -1:
        return F.lit(None).cast("long")
    if f.clock:  # aligned to 1970, the begin of an hour, day, month and year
        return span_end(time, 0, f.freq[0])
    if len(f.freq) == 1:
        return span_end(time, base, f.freq[0])
    phases, at = [], base
    for freq, span in zip(f.freq, f.duration):
        phases.append(Phase(at, later(at, span), freq))
        at = later(at, span)
    return phase_end(time, phases)


def output(
    plan: Plan, name: str, source: DataFrame, time: str, cells: list[str], variable: str, value: str,
    z: str | None = None, weight: str | None = None, late: str = "1 millisecond",
) -> DataFrame:
    """The rows of one output file: ``window_end`` (microseconds), cells, a column a variable.

    Diurnal variables add the column ``section``; each section is divided by the window's
    samples by the number of sections. Attributes of a variable are its column's metadata.

    The source may be a stream without a watermark. A window of it closes once a sample
    has come whose own window ends later by ``late`` or more, which is a millisecond at
    least, or a window would close at its own first sample; windows close in order, and
    ``tidemark.streaming.windows.finish_plan`` writes the last. Diurnal variables and windows that
    end with the run need the whole window at once and are an error on a stream.
    """
    f = next(x for x in plan.files if x.name == name)
    streaming = source.isStreaming
    if streaming and (f.freq[0] == -1 or any(v.method.startswith("diurnal") for v in f.variables)):
        raise ValueError(f"{name}: diurnal variables and windows of the whole run are not made from a stream")
    base = _base_micros(plan.base)
    t = micros(F.col(time))
    rows = source.where(F.col(variable).isin([v.name for v in f.variables])).where(t > base)
    if f.start:
        rows = rows.where(t >= _base_micros(f.start))
    if f.region:
        for column, (low, high) in f.region.items():
            rows = rows.where(F.col(column).between(low, high))
    rows = rows.withColumn("window_end", _ends(f, base, t))
    if len(f.freq) > 1:
        rows = rows.where("window_end is not null")
    n = {int(v.method[7:]) for v in f.variables if v.method.startswith("diurnal")}
    if len(n) > 1:
        raise ValueError(f"{name}: one number of diurnal sections a file")
    keys = ["window_end", *cells]
    if streaming:
        rows = rows.withColumn("window_time", F.timestamp_micros("window_end")).withWatermark("window_time", late)
        keys[0] = "window_time"
    if n:
        rows = rows.withColumn("section", section(t, n.pop()))
        keys.append("section")
    aggregates, shares = [], []
    for v in f.variables:
        chosen = F.col(variable) == v.name
        if v.zbounds and z:
            chosen &= F.col(z).between(*v.zbounds)
        x = F.when(chosen, F.col(value))
        if v.method.startswith("diurnal"):
            w = F.when(x.isNotNull(), F.col(weight) if weight else F.lit(1.0))
            aggregates += [F.sum(x * w).alias(f"__sum_{v.output}"), F.sum(w).alias(f"__n_{v.output}")]
            shares.append(even_share(f"`__sum_{v.output}`", f"`__n_{v.output}`", ["window_end", *cells], int(v.method[7:])).alias(v.output, metadata=v.attributes))
            continue
        method = v.method
        aggregates.append(reduction(method, x, F.when(chosen, F.col(time)), F.col(weight) if weight else None).alias(v.output, metadata=v.attributes))
    out = rows.groupBy(*keys).agg(*aggregates)
    if streaming:
        return out.select(F.unix_micros("window_time").alias("window_end"), *[c for c in out.columns if c != "window_time"])
    if not shares:
        return out
    return out.select(*keys, *[c for c in out.columns if c not in keys and not c.startswith("__")], *shares)


def file_begin(end: Column, base: int, freq: int) -> Column:
    """Begin (microseconds) of the file that holds a window's end."""
    ends = span_end(end, base, freq)
    if not isinstance(freq, Months):
        return ends - F.lit(freq)
    moved = F.timestamp_micros(ends).cast("timestamp_ntz") + F.make_ym_interval(F.lit(0), F.lit(-int(freq)))
    return F.unix_micros(moved.cast("timestamp"))


def write_output(plan: Plan, name: str, rows: DataFrame, path: str) -> None:
    """Write the rows of one file of a plan, by file names of their own if it rotates."""
    f = next(x for x in plan.files if x.name == name)
    if f.name_freq is None:
        rows.write.mode("append").parquet(f"{path}/{name}")
    else:
        write_rotating(rows, f.name, f.name_freq, _base_micros(plan.base), path)


def with_file_name(df: DataFrame, template: str, freq: int, base: int) -> DataFrame:
    """Windows with the column ``file``: the template stamped with the begin of the file they belong to."""
    begin = F.timestamp_micros(file_begin(F.col("window_end"), base, freq)).cast("timestamp_ntz")
    return df.withColumn("file", file_name(template, begin))


def write_rotating(df: DataFrame, template: str, freq: int, base: int, path: str) -> None:
    """Write windows as Parquet partitioned by file name, the name stamped with the file's begin."""
    with_file_name(df, template, freq, base).write.partitionBy("file").mode("append").parquet(path)
