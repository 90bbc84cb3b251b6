"""Streams whose windows are held as state: diurnal sections, the whole run, skipped windows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.plans.diagnostics import output, parse_plan
from tidemark.streaming.stateful import finish_stateful, held_state, write_stateful
from tidemark.streaming.windows import read_plan

PLAN = """
title: t
base_date: 2024 1 1 0 0 0
diag_files:
- {file_name: d, freq: 2 days, varlist: [{module: m, var_name: x, reduction: diurnal8, attributes: {units: K}}, {module: m, var_name: y, reduction: diurnal8}]}
- {file_name: run, freq: -1, varlist: [{module: m, var_name: x, reduction: average}, {module: m, var_name: x, reduction: max, output_name: x_max}, {module: m, var_name: y, reduction: none}]}
- {file_name: day, freq: 1 days, varlist: [{module: m, var_name: x, reduction: rms}, {module: m, var_name: y, reduction: min}, {module: m, var_name: x, reduction: sum, output_name: x_sum}, {module: m, var_name: x, reduction: pow3, output_name: x3}]}
- {file_name: "m%4yr", freq: 1 months, new_file_freq: 1 years, varlist: [{module: m, var_name: x, reduction: average}]}
"""
COLUMNS = ("t", ["c"], "v", "value")


def samples(spark, first, last, every=1):
    """Every three hours two cells of two variables, some values missing."""
    steps = spark.range(first, last, every).select(F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 10_800_000_000).alias("t"), "id")
    both = steps.withColumn("c", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("v", F.explode(F.array(F.lit("x"), F.lit("y"))))
    value = F.when((F.col("id") + F.col("c")) % 11 != 0, (F.col("id") % 17 + F.col("c")).cast("double"))
    return both.select("t", "c", "v", value.alias("value"))


def run(spark, tmp_path, name, parts, **options):
    plan, out, check = parse_plan(PLAN), str(tmp_path / "out"), str(tmp_path / "check")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
        write_stateful(plan, name, stream, out, check, *COLUMNS, **options).awaitTermination()
    return plan, out, check, spark.read.parquet(str(tmp_path / "in"))


def texts(df, columns):
    return sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.select(columns).collect())


@pytest.mark.parametrize("name", ["d", "run", "day", "m%4yr"])
def test_stream_and_its_end_equal_batch(spark, tmp_path, name):
    plan, out, check, source = run(spark, tmp_path, name, [samples(spark, 1, 130), samples(spark, 130, 300)])
    batch = output(plan, name, source, *COLUMNS)
    columns = [c for c in batch.columns]
    want = texts(batch, columns)
    for _ in range(2):
        finish_stateful(plan, name, spark, out, check, ["c"])
        assert texts(read_plan(source, name, out), columns) == want
    if name == "d":
        assert read_plan(source, name, out).schema["x"].metadata == {"units": "K"} and "section" in columns
    closed = spark.read.parquet(f"{out}/{name}").where("batch >= 0").count()
    assert closed == 0 if name == "run" else 0 < closed < len(want)


def test_state_keeps_open_windows_only(spark, tmp_path):
    plan, out, check, source = run(spark, tmp_path, "d", [samples(spark, 1, 130), samples(spark, 130, 300)])
    ends = [r[0] for r in held_state(spark, check, ["c"]).select("window_end").distinct().collect()]
    assert len(ends) <= 2


def test_a_skipped_window_stops_the_stream(spark, tmp_path):
    with pytest.raises(Exception, match="skipped a window"):
        run(spark, tmp_path, "day", [samples(spark, 1, 20), samples(spark, 40, 60)])


def test_a_skipped_window_without_the_rule(spark, tmp_path):
    plan, out, check, source = run(spark, tmp_path, "day", [samples(spark, 1, 20), samples(spark, 40, 60)], strict=False)
    finish_stateful(plan, "day", spark, out, check, ["c"])
    batch = output(plan, "day", source, *COLUMNS)
    assert texts(read_plan(source, "day", out), batch.columns) == texts(batch, batch.columns)


def test_a_sample_of_a_window_that_was_left_stops_the_stream(spark, tmp_path):
    with pytest.raises(Exception, match="after the next window|late"):
        run(spark, tmp_path, "day", [samples(spark, 20, 30), samples(spark, 1, 12)], late="1000 days")
