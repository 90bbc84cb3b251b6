"""The conversation trie against a plain trie of dictionaries."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows: list[tuple]) -> dict[int, list[tuple]]:
    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def tie(role: str, text: str) -> int:
        return signed(xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(role.encode(), 42)))

    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", tie(role or "", text or ""), text or ""))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = turns.get(base, [])[:h] + turns[c][h:]
    return out


def trie(rows: list[tuple]) -> list[tuple]:
    convs = rebuilt(rows)
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids: dict[tuple, list[tuple]] = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[k] for k in kids.get(node, []))
        leaves[node] = sum(leaves[k] for k in kids.get(node, [])) or 1
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(of), len(node), parent, len(of), len(kids.get(node, [])), leaves[node], saved[node], sha256(ends.encode()).hexdigest()))
    return out


def check(spark, tmp_path, rows, extra=None):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.withColumns(extra)
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_conversation_trie(spark, str(tmp_path))
    assert got.columns == COLUMNS
    want = trie(rows)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    return want


def talk(c, texts, role="user"):
    return [(c, i, role, t) for i, t in enumerate(texts)]


def test_shared_beginnings_copies_and_ends(spark, tmp_path):
    rows = [r for c in range(260) for r in talk(c, ["hello", "yes" if c % 2 else "no", f"end {c % 9}"][: 1 + c % 4])]
    rows += [r for c in range(1000, 1040) for r in talk(c, ["one", "two", "three", "four", "five", "six", "seven"])]
    rows += talk(-5, ["minus", "signs"]) + talk(-100, ["base"]) + talk(9_000_000_000_000, ["far", "off"])
    check(spark, tmp_path, rows)


def test_nulls_ties_repeats_and_clashing_columns(spark, tmp_path):
    rows = talk(0, ["a", "b", "c", "d", "e", "f"]) + talk(1, ["a"]) + talk(2, [None, "", "ü😀"], None) + [(3, None, None, None), (3, None, "user", "first"), (3, 0, "", "")]
    rows += [(4, 1, "user", "twice"), (4, 1, "user", "twice"), (4, 1, "bot", "tie"), (4, 1, "user", "tie"), (None, 0, "user", "nobody"), (5, 0, "user", "x" * 100_000)]
    rows += talk(7, ["only", "two"]) + talk(207, ["no base"]) + talk(208, ["no base", "left"])
    extra = {"s": F.lit(1), "d": F.lit("x"), "m": F.lit(2.0), "rank": F.lit(1), "c": F.lit(None).cast("string")}
    check(spark, tmp_path, rows, extra)


def test_turnless_conversations_end_at_the_root(spark, tmp_path):
    rows = [r for c in range(1, 90) for r in talk(c, ["a"])]  # without conversation 0
    want = check(spark, tmp_path, rows)
    assert len(want) == 2 and want[0][1] == 0


def test_only_turnless_conversations(spark, tmp_path):
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6)
    assert len(check(spark, tmp_path, talk(c, ["a"]))) == 1


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_no_conversations(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_conversation_trie(spark, str(tmp_path))
    assert got.columns == COLUMNS and got.collect() == []


def test_long_conversations_that_part_late(spark, tmp_path):
    """More turns than the widest band, shared almost to the end, once more as a copy."""
    common = [f"turn {i % 7}" for i in range(2300)]
    ids = [c for c in range(100, 200) if zlib.crc32(str(c).encode()) % 6 == 0][:4]
    rows = talk(ids[0], [*common, "x"]) + talk(ids[1], [*common, "y", "z"]) + talk(ids[2], [*common, "x"]) + talk(ids[3], common[:700])
    check_depth = check_columns(spark, tmp_path, rows)
    assert max(check_depth) == 2302


def check_columns(spark, tmp_path, rows):
    """As ``check``, with beginnings named by hashes (tuples of 2300 turns are slow)."""
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in queries.op13_conversation_trie(spark, str(tmp_path)).collect()]
    convs, members, length, parent = rebuilt(rows), {}, {}, {}
    for c, turns in convs.items():
        key = b""
        members.setdefault(key, []).append(c)
        length[key] = 0
        for d, (role, text) in enumerate(turns):
            last, key = key, sha256(key + role.encode() + b"\0" + text.encode()).digest()
            members.setdefault(key, []).append(c)
            length[key], parent[key] = len(text), last
            if d == len(turns) - 1:
                parent[key, "end"] = True
    kids: dict[bytes, list] = {}
    depth = {b"": 0}
    for key in members:
        if key:
            kids.setdefault(parent[key], []).append(key)
            depth[key] = depth[parent[key]] + 1
    saved, leaves, want = {}, {}, []
    for key in sorted(members, key=lambda k: -depth[k]):
        saved[key] = (len(members[key]) - 1) * length[key] + sum(saved[k] for k in kids.get(key, []))
        leaves[key] = sum(leaves[k] for k in kids.get(key, [])) or 1
    for key, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(convs[c]) == depth[key])
        above = min(members[parent[key]]) if key else None
        want.append((min(of), depth[key], above, len(of), len(kids.get(key, [])), leaves[key], saved[key], sha256(ends.encode()).hexdigest()))
    assert sorted(map(str, got)) == sorted(map(str, want))
    return [r[1] for r in got]


def test_bands_cover_all_turns(spark):
    rows = spark.range(1, 5000).select("id", conversations.band_of(F.col("id")).alias("band")).collect()
    ends = [conversations.band_end(b) for b in range(20)]
    assert all(r.band == next(b for b, e in enumerate(ends) if r.id <= e) for r in rows)
