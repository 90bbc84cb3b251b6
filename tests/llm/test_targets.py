"""Targets of the mix where sources tie, against water filling by rounds."""

from __future__ import annotations

import random

import pytest

from tests.llm import brute
from tidemark.llm import mixing
from tidemark.llm.shared import with_ranks


def found(spark, sizes, weights=mixing.WEIGHTS, limit=3):
    sources = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    return {r.source: r.target for r in mixing.targets(sources, weights, limit).collect()}


CASES = {
    "four equal": {f"s{i}": 300 for i in range(4)},
    "eight equal": {f"s{i}": 300 for i in range(8)},
    "twenty equal": {f"s{i}": 3 for i in range(20)},
    "equal ratios": {"a": 50, "b": 20, "c": 10, "d": 500, "e": 200, "f": 100},
    "empty sources": {"a": 0, "b": 0, "c": 7, "d": 0, None: 9},
    "null last": {None: 10, "z": 10, "é": 10, "a": 1},
    "one": {"a": 5},
    "one large": {"a": 100_000, **{f"b{i}": 1 for i in range(30)}},
}


@pytest.mark.parametrize("name", CASES)
def test_targets_share_everything(name, spark):
    sizes = CASES[name]
    got = found(spark, sizes)
    assert got == pytest.approx(brute.targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))
    assert all(got[s] <= 3 * sizes[s] + 1e-9 for s in sizes)


def test_targets_of_many_random_sources(spark):
    draw = random.Random(3)
    sizes = {f"host{i}": draw.choice([0, 1, 5, 5, 300, 40_000]) for i in range(3000)}
    assert found(spark, sizes) == pytest.approx(brute.targets(sizes))


def test_targets_of_no_sources(spark):
    assert found(spark, {}) == {}


def test_equal_sources_are_all_taken_from(spark):
    rows = [(i, "word " * 15, f"s{i % 20}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken: dict = {}
    for r in mixing.mix_sources(docs).collect():
        taken.setdefault(r.source, [0, r.target])[0] += r.taken
    assert len(taken) == 20 and all(abs(t - want) <= 15 for t, want in taken.values())
    assert abs(sum(t for t, _ in taken.values()) - 6000) <= 20 * 15


def test_ranks(spark):
    rows = [(g, v) for g in (None, "a", "b") for v in (3, 1, 1, None, 2)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = with_ranks(df, [df.g.asc_nulls_first(), df.v.asc_nulls_first()], ("g",)).collect()
    for g in (None, "a", "b"):
        mine = sorted((r["rank"], r.v) for r in got if r.g == g)
        assert mine == list(enumerate([None, 1, 1, 2, 3]))
