"""Value trees, reports, mask tables, names: odd cases."""

from __future__ import annotations

import pytest
import yaml
from pyspark.sql import functions as F

from tidemark.functions import strings as st
from tidemark.operators import asof, reports, tree
from tidemark.sources import ascii

SCHEMA = "path string, index int, value string, type string"


@pytest.fixture
def small(spark):
    rows = [("/a/x", 0, "1", "int"), ("/a/x", 1, "2", "int"), ("/a/b/y", 0, "t", "text"), ("/c", 0, "3", "int")]
    return spark.createDataFrame(rows, SCHEMA)


def held(df):
    return sorted((r.path, r["index"], r.value) for r in df.collect())


def test_put_and_get(spark, small):
    changes = spark.createDataFrame([("a//x/", 2, "9", "int"), ("/c", None, "4", "int"), ("/new", None, "n", "text")], SCHEMA)
    got = tree.put(small, changes)
    assert held(got) == [("/a/b/y", 0, "t"), ("/a/x", 0, "1"), ("/a/x", 1, "2"), ("/a/x", 2, "9"), ("/c", 0, "4"), ("/new", 0, "n")]
    kept = tree.put(small, changes, protect=True)
    assert held(kept) == [("/a/b/y", 0, "t"), ("/a/x", 0, "1"), ("/a/x", 1, "2"), ("/c", 0, "3"), ("/new", 0, "n")]
    with pytest.raises(Exception, match="a gap in /a/x"):
        tree.put(small, spark.createDataFrame([("/a/x", 5, "9", "int")], SCHEMA)).collect()
    wanted = spark.createDataFrame([("/a/x", 1, "d"), ("a/x", None, "d"), ("/a/x", 7, "d"), ("/no", 0, None)], "path string, index int, default string")
    assert sorted((r.path, r["index"] or 0, r.value) for r in tree.get(small, wanted).collect()) == [("/a/x", 1, "2"), ("/a/x", 7, "d"), ("/no", 0, None), ("a/x", 0, "1")]
    with pytest.raises(Exception, match="is of type text"):
        tree.get(small, spark.createDataFrame([("/a/b/y", 0, "d")], "path string, index int, default string"), "int").collect()


def test_lists_copies_and_unknown_names(spark, small):
    paths = spark.createDataFrame([("/",), ("/a",), ("/a/x",), ("/c",), ("/zz",)], "path string")
    got = {r.path: (r.exists, r.is_list, r.length) for r in tree.exists(small, paths).collect()}
    assert got == {"/": (True, True, 0), "/a": (True, True, 0), "/a/x": (True, False, 2), "/c": (True, False, 1), "/zz": (False, False, 0)}
    assert sorted(map(tuple, tree.children(small, paths).collect())) == [("/", "a"), ("/", "c"), ("/a", "b"), ("/a", "x")]
    pairs = spark.createDataFrame([("/a", "/d/e")], "old string, new string")
    assert held(tree.copy(small, pairs)) == sorted([*held(small), ("/d/e/x", 0, "1"), ("/d/e/x", 1, "2"), ("/d/e/b/y", 0, "t")])
    assert held(tree.copy(small, pairs, move=True)) == [("/c", 0, "3"), ("/d/e/b/y", 0, "t"), ("/d/e/x", 0, "1"), ("/d/e/x", 1, "2")]
    over = spark.createDataFrame([("/a/b", "/c")], "old string, new string")
    assert held(tree.copy(small, over)) == [("/a/b/y", 0, "t"), ("/a/x", 0, "1"), ("/a/x", 1, "2"), ("/c/y", 0, "t")]
    allowed = spark.createDataFrame([("a",)], "name string")
    assert [tuple(r) for r in tree.unknown(small, paths.where("path = '/'"), allowed).collect()] == [("/", "c")]


def test_copies_keep_the_tree_off_the_driver(spark, small, tmp_path):
    """A tree that Spark takes for small is not broadcast, and equal and null paths stay as they are."""
    small.unionByName(spark.createDataFrame([(None, 0, "n", "int"), ("/a/x", 1, "2", "int")], SCHEMA)).write.parquet(str(tmp_path / "tree"))
    pairs = spark.createDataFrame([("/a", "/d"), ("/a/b", "/c")], "old string, new string")
    got = tree.copy(spark.read.parquet(str(tmp_path / "tree")), pairs)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    want = [("/a/b/y", "t"), ("/a/x", "1"), ("/a/x", "2"), ("/a/x", "2"), ("/c/y", "t"), ("/d/b/y", "t"), ("/d/x", "1"), ("/d/x", "2"), ("/d/x", "2"), ("None", "n")]
    assert sorted((str(r.path), r.value) for r in got.collect()) == sorted(want)


def test_columns_and_lines(spark):
    cells = spark.createDataFrame([(i, j, 90.0 * i - 180, 90.0 * i - 90, 45.0 * j - 90, 45.0 * j - 45) for i in range(4) for j in range(4)], "i int, j int, lon0 double, lon1 double, lat0 double, lat1 double")
    points = [("a", 0.0, 90.0), ("b", 359.9, -90.0), ("c", 90.0, 0.0)]
    got = {(r.name, r.i, r.j) for r in reports.diagnostic_columns(cells, points, [("d", 1, 1), ("e", 9, 9)]).collect()}
    assert got == {("a", 2, 3), ("b", 1, 0), ("c", 3, 2), ("d", 1, 1)}
    assert reports.diagnostic_columns(cells).collect() == []
    with pytest.raises(ValueError, match="latitudes"):
        reports.diagnostic_columns(cells, [("x", 0.0, 91.0)])
    df = spark.createDataFrame([(1, "a", 2.0, 1.0), (1, "a", 4.0, 3.0), (1, "b", 1.0, 1.0), (2_000_000_000, "a", 1.0, 1.0), (2_000_000_000, "b", -1.0, 1.0)], "t long, field string, value double, area double")
    lines = {(r.t, r.part): r.line for r in reports.average_lines(df, "t", [("a", "%8.3f"), ("b", "%8.3f")], a_line=1).collect()}
    assert lines[1, 0] == "      1.000   3.500" and lines[1, 1] == "      1.000   1.000" and lines[2_000_000_000, 1] == "   2.000000e+09  -1.000"
    with pytest.raises(Exception, match="b: no value at 1"):
        reports.average_lines(df.where("field = 'a' and t = 1"), "t", [("a", "%f"), ("b", "%f")]).collect()


def test_yaml_reads_back(spark):
    values = {"plain": "a b", "number": "1.5", "word": "yes", "sign": "a: b", "quote": "it's", "empty": "", "octal": "010", "comma": "[x]"}
    rows = [("d", n, "one", k, v, None) for n, (k, v) in enumerate(values.items())] + [("d", 20, "one", "gone", None, None)]
    rows += [("d", 30 + n, "one", k, v, s) for n, (k, v, s) in enumerate([("var", "x", "s1"), ("n", "3", "s1"), ("var", "y", "s2")])] + [("d", 40, "two", "plain", "z", None)]
    df = spark.createDataFrame(rows, "document string, place int, item string, key string, value string, sub string")
    got = yaml.safe_load(reports.yaml_text(df, "document", "files", "vars", {"title": "t"}).first().text)
    assert got["title"] == "t" and got["files"][1] == {"plain": "z"}
    first = got["files"][0]
    assert first.pop("vars") == [{"var": "x", "n": 3}, {"var": "y"}] and first == values | {"number": 1.5}


def test_mask_tables(spark, tmp_path):
    def read(text):
        path = tmp_path / f"t{len(list(tmp_path.iterdir()))}"
        path.write_text(text)
        return ascii.mask_table(spark, str(path))

    blocks, layout = read("2\n# a comment\n4, 6\n\n1,2\n3 , 6\n")
    assert layout == (4, 6) and sorted(map(tuple, blocks.collect())) == [(1, 2), (3, 6)]
    assert read("1\n4,6\n1,2,5")[0].columns == ["i", "j", "tile"] and read("0\n4,6\n")[0].collect() == []
    for wrong in ("2\n4,6\n1,2\n", "1\n4,6\n5,1\n", "2\n4,6\n1,1\n1,1\n", "1\n4,6\n1\n", "4,6\n1,1\n", ""):
        with pytest.raises(ValueError):
            read(wrong)


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    names = F.array(F.lit("a "), F.lit("b"), F.lit("a"), F.lit("c"))
    assert one(st.name_index(names, F.lit("a   "))) == 1 and one(st.all_indices(names, F.lit("a"))) == [1, 3] and one(st.count_unique(names)) == 3
    assert one(st.append_unique(names, F.array(F.lit("d"), F.lit("b ")))) == ["a", "b", "c", "d"]
    assert one(st.chomp(F.lit("text  \0rest"))) == "text" and one(st.copied(F.lit("abc"), 5)) == "abc  " and one(st.copied(F.lit("abcdef"), 3)) == "abc"
    assert one(st.list_text(F.array(F.lit(1), F.lit(2)))) == "1, 2" and one(st.number_text(F.lit(2.5), "%6.2f")) == "  2.50"
    with pytest.raises(Exception, match="too long"):
        one(st.copied(F.lit("abcdef"), 3, strict=True))
    with pytest.raises(Exception, match="behind a period"):
        one(asof.interpolate_modulo([(0.0, 1.0), (30.0, 2.0)], F.lit(3.0), F.lit(28.0)))
