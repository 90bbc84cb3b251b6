"""Merkle manifest of a table: leaves, a tree a group, a tree over the groups, proofs.

Building: leaves are ranked in their group by ranges (``with_ranks``), so that a task's
rows are runs of consecutive leaves. A task combines by key as the digests come: a
parent gathers its children's digests by index until it has as many as the size of its
level says, then it becomes a digest itself and goes to its own parent. What is left
open at the ends of a task's runs (a handful of nodes a level) is dealt out anew by
spans of leaves, and wider spans the next time, until each group has one node left.

Proofs: each node keeps its children's digests, the links back. A node's proof is its
siblings followed by its parent's proof; proofs are handed down in bands of levels, the
nodes of a band below one node together, so a band's task holds one small tree.

All digests are lowercase hex SHA-256 of texts; a parent's is that of its children's,
concatenated. Nodes at ``level`` 0 are leaves; node ``i`` has children ``2 i`` and, if
the level has so many, ``2 i + 1``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import parallelism, shared_table, with_ranks
from tidemark.llm.sql import crc32_sql

ARITY = 2
BAND = 10
MOST_OPEN = 200_000
NULL = "null"
NODES = "grp string, level int, idx long, size long, digest string, children array<string>, open boolean"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def width_at(size: int, level: int) -> int:
    """Nodes that a tree over ``size`` leaves has at a level."""
    return -(-size // ARITY**level)


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that the task can close, with their children, and those it leaves open.

    Nodes come in the order of their leaves, so that few parents wait at a time; where
    they do not, the parents that waited longest are given up to the next round.
    """
    waiting: dict[tuple, dict[int, str]] = {}
    out: list[list] = [[] for _ in range(7)]

    def put(*row) -> None:
        for column, value in zip(out, row):
            column.append(value)

    def flush() -> pa.RecordBatch:
        types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.bool_())
        names = ("grp", "level", "idx", "size", "digest", "children", "open")
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
        for column in out:
            column.clear()
        return batch

    def give_up(key: tuple) -> None:
        grp, size, level, _ = key
        for idx, digest in waiting.pop(key).items():
            put(grp, level - 1, idx, size, digest, None, True)

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("grp", "level", "idx", "size", "digest")]
        for grp, level, idx, size, digest in zip(*columns):
            width = width_at(size, level)
            while width > 1:
                parent, level = idx // ARITY, level + 1
                key = (grp, size, level, parent)
                children = waiting.setdefault(key, {})
                children[idx] = digest
                if len(children) < min(ARITY, width - parent * ARITY):
                    break
                del waiting[key]
                digests = [children[i] for i in sorted(children)]
                digest, idx, width = sha256("".join(digests).encode()).hexdigest(), parent, width_at(size, level)
                put(grp, level, idx, size, digest, digests, False)
            if len(waiting) > MOST_OPEN:
                give_up(next(iter(waiting)))
        if out[0]:
            yield flush()
    for key in list(waiting):
        give_up(key)
    yield flush()


def build_nodes(leaves: DataFrame) -> DataFrame:
    """Inner nodes ``(grp, level, idx, size, digest, children)`` over ``leaves(grp, idx, size, digest)``.

    ``idx`` counts from 0 in each group, ``size`` is the group's. A group of one leaf has
    no inner node; no leaves give no rows.
    """
    spark = leaves.sparkSession
    leaves = leaves.select("grp", F.lit(0).alias("level"), "idx", "size", "digest")
    made = shared_table(leaves.sortWithinPartitions("grp", "idx").mapInArrow(_climb, NODES), "merkle-nodes")
    parts, span = [made.where("not open").drop("open")], 12
    left = made.where("open").drop("open", "children")
    while not left.isEmpty():
        start = F.expr("shiftleft(idx, level)")
        key = ["grp", "size", F.shiftright(start, span)]
        dealt = left.repartition(parallelism(spark), *key).sortWithinPartitions("grp", "size", start, "level")
        made = shared_table(dealt.mapInArrow(_climb, NODES), "merkle-nodes")
        parts.append(made.where("not open").drop("open"))
        left, span = made.where("open").drop("open", "children"), span + BAND
    nodes = parts[0]
    for more in parts[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def n_siblings(idx: int, size: int) -> int:
    """Length of the proof of leaf ``idx`` of ``size``."""
    n = 0
    while size > 1:
        first = idx - idx % ARITY
        n, idx, size = n + min(ARITY, size - first) - 1, idx // ARITY, width_at(size, 1)
    return n


def _hand_down(batches: Iterator[pa.RecordBatch], lowest: bool, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Proofs handed from nodes to their children, within a band of levels.

    Rows are sorted by (grp, size, top, rank): first the proof of the node above the
    band's tree, then its inner nodes by falling level, in the lowest band its leaves.
    Only the proofs of one tree are held. Out come the nodes that the next band begins
    with or, in the lowest, the leaves with what their claims fold to.
    """
    types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), id_type, pa.string(), pa.string(), pa.string())
    names = ("grp", "size", "level", "idx", "subroot", "grp_idx", "n_grps", "proof", "id", "leaf", "claim", "folded_root")
    current, proofs = None, {}
    for batch in batches:
        taken = ("grp", "size", "top", "level", "idx", "subroot", "grp_idx", "n_grps", "proof", "children", "id", "leaf", "claim")
        rows: list[tuple] = []
        for grp, size, top, level, idx, subroot, grp_idx, n_grps, proof, children, key, leaf, claim in zip(*[batch.column(n).to_pylist() for n in taken]):
            if (grp, size, top) != current:
                current, proofs = (grp, size, top), {}
            if proof is not None:
                proofs[level, idx] = ((subroot, grp_idx, n_grps), proof)
            elif children is None:
                whose, own = proofs.pop((0, idx))
                claim = leaf if claim is None else claim
                split = n_siblings(idx, size)
                folded = fold(fold(claim, idx, size, own[:split]), *whose[1:], own[split:])
                rows.append((grp, size, 0, idx, *whose, own, key, leaf, claim, folded))
            else:
                whose, above = proofs.pop((level, idx))
                for k in range(len(children)):
                    child, own = idx * ARITY + k, children[:k] + children[k + 1 :] + above
                    proofs[level - 1, child] = (whose, own)
                    if not lowest and (level - 1) % BAND == 0:
                        rows.append((grp, size, level - 1, child, *whose, own, None, None, None, None))
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))


def top_nodes(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(grp, size, level, idx, subroot)``: the one node at the top of each group."""
    inner = nodes.groupBy("grp", "size").agg(F.max_by(F.struct("level", "digest"), "level").alias("top"))
    inner = inner.select("grp", "size", F.col("top.level").alias("level"), F.lit(0).cast("long").alias("idx"), F.col("top.digest").alias("subroot"))
    single = leaves.where("size = 1").select("grp", "size", F.lit(0).alias("level"), "idx", F.col("digest").alias("subroot"))
    return inner.unionByName(single)


def proofs_of(leaves: DataFrame, nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """``(grp, size, idx, subroot, grp_idx, n_grps, proof, id, leaf, claim, folded_root)`` a leaf.

    ``leaves(grp, idx, size, digest, id, claim)``; ``tops`` are ``top_nodes`` with their
    own place (``grp_idx`` of ``n_grps``) and ``proof`` in the tree over the groups. A
    null claim is the leaf itself.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = leaves.sparkSession
    kind = leaves.schema["id"].dataType
    id_type = to_arrow_type(kind)
    schema = f"{PROOFS}, id {kind.simpleString()}, leaf string, claim string, folded_root string"
    height = tops.agg(F.max("level")).first()[0] or 0
    begin_columns = ["grp", "size", "level", "idx", "subroot", "grp_idx", "n_grps", "proof"]
    waiting = tops.select(begin_columns).where("false")
    for band in range(max(height - 1, 0) // BAND, -1, -1):
        low, high = band * BAND, (band + 1) * BAND
        inside = (F.col("level") > low) & (F.col("level") <= high)
        top = F.expr(f"shiftrightunsigned(idx, {high} - level)").alias("top")
        begin = waiting.unionByName(tops.select(begin_columns).where(inside if band else F.col("level") <= high))
        rows = begin.select("*", top, F.lit(high + 1).alias("rank"))
        inner = nodes.where(inside).select("grp", "size", "level", "idx", "children", top, F.col("level").alias("rank"))
        rows = rows.unionByName(inner, allowMissingColumns=True)
        if band:
            rows = rows.select("*", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("string").alias("leaf"), F.lit(None).cast("string").alias("claim"))
        else:
            own = leaves.select("grp", "size", F.lit(0).alias("level"), "idx", F.shiftrightunsigned("idx", high).alias("top"), F.lit(0).alias("rank"), "id", F.col("digest").alias("leaf"), "claim")
            rows = rows.unionByName(own, allowMissingColumns=True)
        rows = rows.repartition(parallelism(spark), "grp", "size", "top").sortWithinPartitions("grp", "size", "top", F.desc("rank"))
        made = rows.mapInArrow(lambda batches, lowest=not band: _hand_down(batches, lowest, id_type), schema)
        waiting = shared_table(made.select(begin_columns), "merkle-proofs") if band else made
    return waiting.drop("level")


PROOFS = "grp string, size long, level int, idx long, subroot string, grp_idx long, n_grps long, proof array<string>"


def fold(leaf: str, idx: int, size: int, proof: list[str]) -> str:
    """The root that a leaf and its proof lead to, from its place alone."""
    width, at = size, 0
    while width > 1:
        first = idx - idx % ARITY
        others = min(ARITY, width - first) - 1
        around = proof[at : at + others]
        own = idx % ARITY
        leaf = sha256("".join([*around[:own], leaf, *around[own:]]).encode()).hexdigest()
        at, idx, width = at + others, idx // ARITY, -(-width // ARITY)
    return leaf


def merkle_manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = COLUMNS,
    id_col: str = "doc_id",
    group_col: str = "lang",
    claims: dict[str, Column] | None = None,
) -> DataFrame:
    """A row of ``docs``: doc_id, grp, idx, size, leaf, subroot, root, proof, claim, folded_root, verified.

    A leaf is the digest of ``columns``. Groups are the values of ``group_col``, null
    first, then by UTF-8 bytes; leaves ascend by id, null first, repeated ids by their
    digest. ``proof`` is the siblings from the leaf to the root of all groups. ``claims``
    are columns as someone claims them to be: the claimed leaf is folded with the
    original siblings to ``folded_root``, and ``verified`` says whether that is the
    root. Null values count as ``-`` and so differ from empty texts; texts of any
    length are hashed whole. Other columns, whatever their names, are left alone. An
    empty table gives no rows.
    """
    original = [F.col(f"`{c}`") for c in columns]
    claimed = [(claims or {}).get(c, F.col(f"`{c}`")) for c in columns]
    changed = F.lit(False)
    for mine, theirs in zip(original, claimed):
        changed = changed if mine is theirs else changed | ~mine.eqNullSafe(theirs)
    claim = F.when(changed, leaf_digest(*claimed))
    group = F.col(f"`{group_col}`").cast("string")
    leaves = docs.select(F.col(f"`{id_col}`").alias("id"), group.alias("grp"), leaf_digest(*original).alias("digest"), claim.alias("claim"))
    order = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest").asc()]
    ranked = shared_table(with_ranks(leaves, order, ("grp",)).withColumnRenamed("rank", "idx"), "merkle-ranked")
    sizes = shared_table(ranked.groupBy("grp").agg(F.count("*").alias("size")), "merkle-sizes")
    sizes = sizes.select(F.col("grp").alias("of"), "size")
    # null has a name that no group has
    named = F.coalesce(F.concat(F.lit("="), F.col("grp")), F.lit(NULL)).alias("grp")
    leaves = ranked.join(sizes, F.col("grp").eqNullSafe(F.col("of"))).select(named, "idx", "size", "digest", "id", "claim")
    leaves = shared_table(leaves, "merkle-leaves")
    nodes = build_nodes(leaves)

    tops = shared_table(top_nodes(leaves, nodes), "merkle-tops")
    order = [(F.col("grp") != NULL).asc(), F.col("grp").asc()]
    placed = shared_table(with_ranks(tops, order).withColumnRenamed("rank", "grp_idx"), "merkle-tops")
    n_groups = placed.count()
    none = F.lit(None).cast("string")
    above = placed.select(F.lit("").alias("grp"), F.col("grp_idx").alias("idx"), F.lit(n_groups).cast("long").alias("size"), F.col("subroot").alias("digest"), F.col("grp_idx").alias("id"), none.alias("claim"))
    above_nodes = build_nodes(above)
    root = shared_table(top_nodes(above, above_nodes), "merkle-root")
    alone = root.select("*", F.lit(0).cast("long").alias("grp_idx"), F.lit(1).cast("long").alias("n_grps"), F.array().cast("array<string>").alias("proof"))
    group_proofs = proofs_of(above, above_nodes, alone).select(F.col("id").alias("of"), "proof")
    tops = placed.join(group_proofs, F.col("grp_idx") == F.col("of")).drop("of").withColumn("n_grps", F.lit(n_groups).cast("long"))

    proofs = proofs_of(leaves, nodes, shared_table(tops, "merkle-tops"))
    found = root.first()
    whole = F.lit(found["subroot"] if found else None).cast("string")
    named = F.when(F.col("grp") != NULL, F.substring("grp", 2, 1 << 30))
    return proofs.select(
        F.col("id").alias("doc_id"), named.alias("grp"), "idx", "size", "leaf", "subroot", whole.alias("root"),
        "proof", "claim", "folded_root", (F.col("folded_root") == whole).alias("verified"),
    )


def tampered(id_col: str = "doc_id", value_col: str = "n_chars", every: int = 7) -> dict[str, Column]:
    """Claims that add 1 to a column where ``every`` divides the id's CRC-32."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    return {value_col: F.when(hit, F.col(value_col) + 1).otherwise(F.col(value_col))}


_FIELD = "coalesce(strlen(({0})::VARCHAR) || ':' || ({0})::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in COLUMNS)
_CLAIM = _LEAF.replace("(n_chars)", f"(n_chars + CASE WHEN coalesce({crc32_sql('doc_id::VARCHAR')} % 7 = 0, false) THEN 1 ELSE 0 END)")

MERKLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, sha256({_LEAF}) AS leaf, sha256({_CLAIM}) AS claim,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS size
  FROM documents),
tree AS (
  SELECT coalesce('=' || lang, '') AS grp, 0 AS level, idx, size AS width, leaf AS digest FROM leaves
  UNION ALL
  SELECT grp, level + 1, idx // 2, (width + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx))
  FROM tree WHERE width > 1 GROUP BY grp, level, idx // 2, width),
tops AS (SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS size FROM tree WHERE width = 1),
upper AS (
  SELECT 0 AS level, idx, size AS width, digest FROM tops
  UNION ALL
  SELECT level + 1, idx // 2, (width + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx))
  FROM upper WHERE width > 1 GROUP BY level, idx // 2, width),
climb AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, 0 AS level, idx, size AS width, claim AS cur, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, c.grp, c.level + 1, c.idx // 2, (c.width + 1) // 2,
         sha256(CASE WHEN t.digest IS NULL THEN cur WHEN c.idx % 2 = 0 THEN cur || t.digest ELSE t.digest || cur END), proof || coalesce(t.digest, '')
  FROM climb c LEFT JOIN tree t ON t.grp = c.grp AND t.level = c.level AND t.idx = xor(c.idx, 1) WHERE c.width > 1),
over_groups AS (
  SELECT doc_id, t.digest AS subroot, 0 AS level, t.idx, t.size AS width, cur, proof FROM climb c JOIN tops t ON t.grp = c.grp WHERE c.width = 1
  UNION ALL
  SELECT doc_id, subroot, o.level + 1, o.idx // 2, (o.width + 1) // 2,
         sha256(CASE WHEN t.digest IS NULL THEN cur WHEN o.idx % 2 = 0 THEN cur || t.digest ELSE t.digest || cur END), proof || coalesce(t.digest, '')
  FROM over_groups o LEFT JOIN upper t ON t.level = o.level AND t.idx = xor(o.idx, 1) WHERE o.width > 1)
SELECT l.doc_id, l.leaf, o.subroot, r.digest AS root, sha256(o.proof) AS proof_sha256, o.cur AS folded_root, o.cur = r.digest AS verified
FROM leaves l JOIN over_groups o ON o.doc_id = l.doc_id AND o.width = 1 CROSS JOIN (SELECT digest FROM upper WHERE width = 1) r
"""
