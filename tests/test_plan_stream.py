"""A plan's files written from a stream hold the windows of the batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.plans.diagnostics import output, parse_plan
from tidemark.streaming.windows import finish_plan, read_plan, write_plan

PLAN = """
title: t
base_date: 2024 1 1 0 0 0
diag_files:
- {file_name: a, freq: 1 days, varlist: [{module: m, var_name: x, reduction: average, attributes: {units: K}}, {module: m, var_name: y, reduction: max}]}
- {file_name: "m%4yr%2mo", freq: 1 months, new_file_freq: 1 years, varlist: [{module: m, var_name: x, reduction: sum}]}
- {file_name: d, freq: 1 days, varlist: [{module: m, var_name: x, reduction: diurnal2}]}
"""
COLUMNS = ("t", ["c"], "v", "value")


def samples(spark, first, last):
    """Every six hours two cells of two variables."""
    steps = spark.range(first, last).select(F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 21_600_000_000).alias("t"), "id")
    both = steps.withColumn("c", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("v", F.explode(F.array(F.lit("x"), F.lit("y"))))
    return both.select("t", "c", "v", (F.col("id") % 17 + F.col("c")).cast("double").alias("value"))


@pytest.mark.parametrize(("name", "columns"), [("a", ["window_end", "c", "x", "y"]), ("m%4yr%2mo", ["window_end", "c", "x"])])
def test_stream_of_a_plan_equals_batch(spark, tmp_path, name, columns):
    plan, out, check = parse_plan(PLAN), str(tmp_path / "out"), str(tmp_path / "check")
    for n, (first, last) in enumerate(((1, 300), (300, 420))):  # the second call goes on from the first
        samples(spark, first, last).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.read.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
        write_plan(plan, name, stream, out, check, *COLUMNS).awaitTermination()
    want = sorted(tuple(r) for r in output(plan, name, source, *COLUMNS).select(columns).collect())
    closed = sorted(tuple(r) for r in read_plan(source, name, out).select(columns).collect())
    assert closed and closed == [r for r in want if r[0] < want[-1][0]]
    for _ in range(2):  # a repeated end changes nothing
        finish_plan(plan, name, source, out, *COLUMNS)
        assert sorted(tuple(r) for r in read_plan(source, name, out).select(columns).collect()) == want
    if name == "a":
        assert read_plan(source, name, out).schema["x"].metadata == {"units": "K"}
    else:
        assert "file" in read_plan(source, name, out).columns


@pytest.mark.parametrize("name", ["a", "m%4yr%2mo"])
@pytest.mark.parametrize("runs", [0, 1])
def test_a_stream_that_closes_nothing(spark, tmp_path, name, runs):
    """No batch at all, or one that leaves every window open: the end writes them, once."""
    plan, out = parse_plan(PLAN), str(tmp_path / "out")
    samples(spark, 1, 4).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    for _ in range(runs):
        stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
        write_plan(plan, name, stream, out, str(tmp_path / "check"), *COLUMNS).awaitTermination()
    want = sorted(map(str, output(plan, name, source, *COLUMNS).drop("file").collect()))
    for _ in range(2):
        finish_plan(plan, name, source, out, *COLUMNS)
        got = read_plan(source, name, out)
        assert sorted(map(str, got.select(output(plan, name, source, *COLUMNS).columns).collect())) == want and want


def test_a_stream_makes_no_diurnal_file(spark, tmp_path):
    samples(spark, 1, 5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(samples(spark, 1, 2).schema).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="stream"):
        output(parse_plan(PLAN), "d", stream, *COLUMNS)
