"""The chunked array source: slabs, pushed filters, commits."""

from __future__ import annotations

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import arrays


def cube(spark, n=20, m=9):
    df = spark.range(n * m * 3).select((F.col("id") % n).alias("i"), (F.floor(F.col("id") / n) % m).alias("j"), F.floor(F.col("id") / (n * m)).alias("t"))
    df = df.select("t", "j", "i", F.when((F.col("i") + F.col("j")) % 5 != 0, F.col("t") * 10000 + F.col("j") * 100.5 + F.col("i")).alias("x"))
    return df.where("i + j <> 7")  # some cells are absent, some null


def rows(df):
    return sorted(map(str, df.select("t", "j", "i", "x").collect()))


def index_of(path):
    with open(path, "rb") as f:
        return arrays.read_index(f, os.path.getsize(path))


def spoil(path, keep):
    """Overwrite the bytes of every chunk that ``keep(at)`` does not hold."""
    spoiled = 0
    for name in glob.glob(f"{path}/data/*.chunks"):
        chunks = index_of(name)["chunks"]
        with open(name, "r+b") as f:
            for c in chunks:
                if not keep(c["at"]):
                    f.seek(c["offset"])
                    f.write(b"\0" * c["length"])
                    spoiled += 1
    return spoiled


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_round_trip_with_nulls_and_absent_cells(spark, tmp_path, scheme):
    path, df = f"{scheme}{tmp_path}/a", cube(spark)
    arrays.write_array(df, path, ["t", "j", "i"], "x", [2, 4, 8], attributes={"units": "K"})
    back = arrays.read_array(spark, path)
    assert rows(back) == rows(df) and back.schema["x"].metadata == {"units": "K"}


def test_a_slab_reads_only_its_chunks(spark, tmp_path):
    path, df = str(tmp_path / "a"), cube(spark)
    arrays.write_array(df, path, ["t", "j", "i"], "x", [1, 4, 8])
    assert spoil(path, lambda at: at[0] == 1 and at[2] in (0, 1)) > 0
    slab = arrays.read_array(spark, path, {"t": 1, "i": 3}, {"t": 1, "i": 9})
    assert rows(slab) == rows(df.where("t = 1 and i between 3 and 11"))
    plan = spark._jvm.PythonSQLUtils.explainString(slab._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [GreaterThanOrEqual(t,1), LessThan(t,2), GreaterThanOrEqual(i,3), LessThan(i,12)]" in plan
    assert "Filter (" not in plan
    with pytest.raises(Exception):
        arrays.read_array(spark, path).count()


@pytest.mark.parametrize("condition", ["i = 4", "i in (1, 17, 400)", "i > 4 and i < 4", "j >= 3 and j <= 5 and t < 2", "x > 500", "i = 3 or j = 2", "i in (1, 2) and i in (2, 3)", "x is null and j <> 2", "t = 99"])
def test_filters(spark, tmp_path, condition):
    path, df = str(tmp_path / "a"), cube(spark)
    arrays.write_array(df, path, ["t", "j", "i"], "x", [2, 3, 5])
    assert rows(arrays.read_array(spark, path).where(condition)) == rows(df.where(condition))


def test_append_along_time_and_overwrite(spark, tmp_path):
    path, df = str(tmp_path / "a"), cube(spark)
    for t in range(3):
        arrays.write_array(df.where(F.col("t") == t), path, ["t", "j", "i"], "x", [1, 4, 8])
    assert rows(arrays.read_array(spark, path)) == rows(df)
    with pytest.raises(Exception, match="keeps its axes"):
        arrays.write_array(df, path, ["t", "j", "i"], "x", [2, 4, 8])
    arrays.write_array(df.where("t = 0"), path, ["t", "j", "i"], "x", [3, 3, 3], mode="overwrite")
    assert rows(arrays.read_array(spark, path)) == rows(df.where("t = 0"))


def test_rows_in_any_order_without_the_helper(spark, tmp_path):
    """Chunks that several tasks hold in part are read together."""
    path, df = str(tmp_path / "a"), cube(spark)
    arrays.use_arrays(spark)
    shuffled = df.withColumn("x", F.col("x").cast("double")).orderBy(F.rand(3)).repartition(3)
    shuffled.write.format(arrays.FORMAT).options(axes="t,j,i", chunk="2,4,8", value="x").mode("append").save(path)
    assert rows(arrays.read_array(spark, path)) == rows(df)


def test_a_failed_write_leaves_nothing_to_read(spark, tmp_path):
    path, df = str(tmp_path / "a"), cube(spark)
    arrays.write_array(df.where("t = 0"), path, ["t", "j", "i"], "x", [1, 4, 8])
    broken = df.where("t = 1").withColumn("i", F.when(F.col("i") != 12, F.col("i")))
    with pytest.raises(Exception, match="no i"):
        arrays.write_array(broken, path, ["t", "j", "i"], "x", [1, 4, 8])
    assert rows(arrays.read_array(spark, path)) == rows(df.where("t = 0"))
    commit = json.load(open(glob.glob(f"{path}/commits/*.json")[0]))
    assert len(glob.glob(f"{path}/commits/*")) == 1 and commit["layout"]["axes"] == ["t", "j", "i"]


def test_empty_arrays(spark, tmp_path):
    path, df = str(tmp_path / "a"), cube(spark)
    arrays.write_array(df.limit(0), path, ["t", "j", "i"], "x", [1, 4, 8])
    assert rows(arrays.read_array(spark, path)) == []
    with pytest.raises(Exception, match="give its axes"):
        arrays.read_array(spark, str(tmp_path / "none"))
