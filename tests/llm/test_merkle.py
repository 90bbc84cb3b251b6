"""The Merkle manifest against a tree built in one process."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    out = []
    for v in row:
        v = None if v is None else str(v)
        out.append("-" if v is None else f"{len(v.encode())}:{v}")
    return H(*out)


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree: list[list[str]], i: int) -> list[str]:
    proof = []
    for level in tree[:-1]:
        proof += [level[i ^ 1]] if i ^ 1 < len(level) else []
        i //= 2
    return proof


def climb(tree, i: int, cur: str) -> str:
    for level in tree[:-1]:
        other = [level[i ^ 1]] if i ^ 1 < len(level) else []
        cur = H(*([cur, *other] if i % 2 == 0 else [*other, cur]))
        i //= 2
    return cur


def manifest(rows: list[tuple]) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]])
    upper = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            claim = list(r)
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                claim[3] += 1
            folded = climb(upper, k, climb(trees[g], i, leaf(claim)))
            proof = path(trees[g], i) + path(upper, k)
            out.append((r[0], leaf(r), trees[g][-1][0], upper[-1][0], H(*proof), folded, folded == upper[-1][0]))
    return out


def check(spark, tmp_path, rows, parts=3, extra=None):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.withColumns(extra)
    df.repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = manifest(rows)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    return want


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17])
def test_small_trees(n, spark, tmp_path):
    check(spark, tmp_path, [(i * 3, "s", "en", i, f"text {i}") for i in range(n)])


def test_groups_nulls_ties_and_long_texts(spark, tmp_path):
    rows = [(i, None if i % 4 == 0 else f"s{i}", [None, "", "en", "é", "z", "null"][i % 6], None if i % 5 == 0 else i, [None, "", "x" * 300_000, "ñandú"][i % 4]) for i in range(60)]
    rows += [(None, None, None, None, None), (None, "s", None, 7, "a"), (14, "s", "en", 1, "twice"), (14, "s", "en", 1, "twice"), (-7, "s", "one", 2, "b")]
    extra = {"digest": F.lit(1), "idx": F.lit("x"), "grp": F.lit("y"), "rank": F.lit(2.0), "proof": F.lit(None).cast("string")}
    want = check(spark, tmp_path, rows, extra=extra)
    assert {w[-1] for w in want} == {True, False}


def test_many_leaves_in_several_bands(spark, tmp_path):
    """One group holds most rows, and trees are higher than a band."""
    want = check(spark, tmp_path, [(i, "s", "en" if i % 5 else f"l{i % 40}", i, f"t{i}") for i in range(3000)], parts=7)
    changed = [w for w in want if zlib.crc32(str(w[0]).encode()) % 7 == 0]
    assert changed and not any(w[-1] for w in changed) and all(w[-1] for w in want if w not in changed)


def test_many_groups(spark, tmp_path):
    check(spark, tmp_path, [(i, None, f"g{i % 1500}", None, "t") for i in range(1600)])


def test_empty_table(spark, tmp_path):
    check(spark, tmp_path, [])


def test_proofs_are_real_and_verify(spark):
    df = spark.createDataFrame([(f"k{i}", "a", i) for i in range(11)], "key string, part string, v int")
    rows = merkle.merkle_manifest(df, columns=("key", "v"), id_col="key", group_col="part").collect()
    assert all(r.verified and merkle.fold(r.leaf, r.idx, r.size, r.proof) == r.root == r.subroot for r in rows)
    assert not any(merkle.fold(r.claim[::-1], r.idx, r.size, r.proof) == r.root for r in rows)
    wrong = merkle.merkle_manifest(df, ("key", "v"), "key", "part", claims={"v": F.col("v") * F.when(F.col("v") == 3, 2).otherwise(1)})
    assert {r.doc_id for r in wrong.where("not verified").collect()} == {"k3"}


def test_what_a_task_cannot_close_stays_open():
    import pyarrow as pa

    def batch(ids):
        return pa.RecordBatch.from_pydict({"grp": ["g"] * len(ids), "level": [0] * len(ids), "idx": ids, "size": [5] * len(ids), "digest": [f"d{i}" for i in ids]})

    made = [r for b in merkle._climb(iter([batch([1, 2]), batch([3, 4])])) for r in b.to_pylist()]
    assert {(r["level"], r["idx"], r["open"]) for r in made} == {(0, 1, True), (1, 1, False), (1, 1, True), (1, 2, False), (2, 1, False), (2, 1, True)}
